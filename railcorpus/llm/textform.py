"""Consistent form of text, token hashes and shingles on flat numpy code-point arrays.

A batch of strings is decoded once into one code-point array with row offsets. Lookup tables built from
Unicode's own data map every code point to the start and length of its expansion; marks are then composed
in vectorised rounds. No Python call is made per row.

Consistent form: compatibility decomposition, invisible characters dropped, every kind of single space and
of hyphen unified, look-alike letters replaced by the Latin letter, marks put in canonical order and composed
again. Letter case, visible accents and the number of spaces are kept. Null stays null, empty stays empty.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa

# Letters of other scripts drawn like a Latin letter.
LOOKALIKES = dict(
    zip(
        "аеорсухѕіјһԁԛԝӏАВЕКМНОРСТУХЅІЈԚԜΑΒΕΖΗΙΚΜΝΟΡΤΥΧονօ",
        "aeopcyxsijhdqwlABEKMHOPCTYXSIJQWABEZHIKMNOPTYXovo",
        strict=True,
    )
)
# Radical forms without a compatibility mapping, and the ideograph each is drawn as.
RADICALS = dict(
    zip(
        "⺎⺟⺠⻁⻄⻅⻆⻋⻓⻔⻘⻙⻚⻛⻜⻝⻢⻤⻥⻦⻧⻨⻩⻬⻮⻰",
        "兀母民虎西见角车长门青韦页风飞食马鬼鱼鸟卤麦黄齐齿龙",
        strict=True,
    )
)
# Kinds of hyphen beyond those that compatibility mapping already unifies.
HYPHENS = "‐‑⁃﹣－­‒−"
# Characters that show nothing although their category is not Cf.
BLANK_MARKS = "͏ᅟᅠ឴឵᠋᠌᠍᠏ㅤﾠ"
# Cf characters that are drawn.
DRAWN_FORMATS = "؀؁؂؃؄؅۝܏࢐࢑࣢"

LIMIT = 0x30000  # beyond lie variation selectors and tags (dropped) and private planes (kept)
SEPARATOR, WORD, HAN = 0, 1, 2


def _invisible(ch: str) -> bool:
    cp = ord(ch)
    if ch in BLANK_MARKS or 0xFE00 <= cp <= 0xFE0F:
        return True
    kind = unicodedata.category(ch)
    return (kind == "Cf" and ch not in DRAWN_FORMATS) or (kind == "Cc" and ch not in "\t\n\r")


def _unfold(ch: str) -> str:
    """Expansion of one code point, marks decomposed."""
    if _invisible(ch):
        return ""
    if "가" <= ch <= "힣":
        return ch
    out = []
    for c in unicodedata.normalize("NFKD", ch):
        if _invisible(c):
            continue
        if unicodedata.category(c) == "Zs" and c != " " or c == "⠀":
            c = " "
        elif c in HYPHENS:
            c = "-"
        out.append(LOOKALIKES.get(c, RADICALS.get(c, c)))
    return "".join(out)


def _is_han(cp: int) -> bool:
    return 0x3400 <= cp <= 0x4DBF or 0x4E00 <= cp <= 0x9FFF or 0xF900 <= cp <= 0xFAFF or 0x20000 <= cp <= 0x2FFFF or cp in (0x3005, 0x3007)


class _Tables:
    def __init__(self) -> None:
        start = np.zeros(LIMIT, np.int32)
        size = np.ones(LIMIT, np.uint8)
        pool: list[int] = []
        single = np.arange(LIMIT, dtype=np.uint32)
        ccc = np.zeros(LIMIT, np.uint8)
        kind = np.zeros(LIMIT, np.uint8)
        lower = np.arange(LIMIT, dtype=np.uint32)
        pairs: dict[tuple[int, int], int] = {}
        for cp in range(LIMIT):
            if 0xD800 <= cp <= 0xDFFF:
                continue
            ch = chr(cp)
            cat = unicodedata.category(ch)
            if cat == "Cn":
                continue
            if _is_han(cp):
                kind[cp] = HAN
            elif cat[0] == "L" or cat == "Nd":
                kind[cp] = WORD
            ccc[cp] = unicodedata.combining(ch)
            low = ch.lower()
            if len(low) == 1:
                lower[cp] = ord(low)
            if cp < 0x80 and cat != "Cc":
                continue
            text = _unfold(ch)
            if text != ch:
                size[cp] = len(text)
                if len(text) == 1:
                    single[cp] = ord(text)
                else:
                    start[cp] = len(pool)
                    pool.extend(map(ord, text))
            parts = unicodedata.decomposition(ch).split()
            if len(parts) == 2 and parts[0][0] != "<" and unicodedata.normalize("NFC", ch) == ch:
                pairs[int(parts[0], 16), int(parts[1], 16)] = cp
        self.start, self.size, self.single, self.pool = start, size, single, np.array(pool, np.uint32)
        self.ccc, self.kind, self.lower = ccc, kind, lower
        keys = np.array([(a << 21) | b for a, b in pairs], np.uint64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_to = keys[order], np.array(list(pairs.values()), np.uint32)[order]
        # 64-bit mixing values by code point and position weights for row and token hashes
        self.mix = _splitmix(np.arange(LIMIT, dtype=np.uint64))


@lru_cache(1)
def tables() -> _Tables:
    return _Tables()


def _splitmix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x + np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _take(table: np.ndarray, cps: np.ndarray, beyond) -> np.ndarray:
    """table[cps], with a value for code points beyond the table."""
    if len(cps) and int(cps.max()) >= LIMIT:
        out = table[np.minimum(cps, LIMIT - 1)]
        far = cps >= LIMIT
        out[far] = cps[far] if beyond is None else beyond
        return out
    return table[cps]


def codepoints(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Flat code points, row offsets (n + 1) and validity of a string column; a null row is empty."""
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(arr, pa.ChunkedArray):
        arr = pa.concat_arrays(arr.chunks) if arr.num_chunks else pa.array([], pa.string())
    arr = arr.cast(pa.large_string())
    n = len(arr)
    valid = np.asarray(arr.is_valid()) if arr.null_count else np.ones(n, bool)
    if arr.null_count:
        arr = arr.fill_null("")
    if n == 0:
        return np.zeros(0, np.uint32), np.zeros(1, np.int64), valid
    offs = np.frombuffer(arr.buffers()[1], np.int64, n + 1, arr.offset * 8)
    raw = arr.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offs[0] : offs[-1]] if raw is not None else np.zeros(0, np.uint8)
    offs = offs - offs[0]
    cps = np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(cps) == len(data):
        return cps, offs, valid
    seen = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=seen[1:])
    return cps, seen[offs], valid


def strings(cps: np.ndarray, offs: np.ndarray, valid: np.ndarray) -> pa.Array:
    """The inverse of codepoints."""
    data = cps.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
    width = np.zeros(len(cps) + 1, np.int64)
    np.cumsum(1 + (cps >= 0x80).astype(np.int64) + (cps >= 0x800) + (cps >= 0x10000), out=width[1:])
    mask = None if valid.all() else pa.py_buffer(np.packbits(valid, bitorder="little").tobytes())
    out = pa.Array.from_buffers(pa.large_string(), len(valid), [mask, pa.py_buffer(width[offs].tobytes()), pa.py_buffer(data)])
    return out.cast(pa.string())


def _rows(offs: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(offs) - 1), np.diff(offs))


def unify(cps: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Consistent form of flat code points."""
    if len(cps) and 0x1F < int(cps.min()) and int(cps.max()) < 0x7F:
        return cps, offs
    return _compose(*_expand(cps, offs))


def _expand(cps: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    t = tables()
    size = _take(t.size, cps, 1)
    if len(cps) and int(cps.max()) >= 0xE0000:
        size[(cps >= 0xE0000) & (cps <= 0xE0FFF)] = 0
    out = _take(t.single, cps, None)
    odd = np.flatnonzero(size != 1)
    if len(odd):
        n = size[odd].astype(np.int64)
        moved = np.concatenate([[0], np.cumsum(n - 1)])
        at = np.repeat(odd + moved[:-1], n) + _within(n)
        rest = np.ones(len(cps) + moved[-1], bool)
        rest[at] = False
        whole = np.empty(len(rest), np.uint32)
        whole[rest] = out[size == 1]
        many = n > 1
        whole[at] = t.pool[np.repeat(t.start[np.minimum(cps[odd[many]], LIMIT - 1)], n[many]) + _within(n[many])]
        out, offs = whole, offs + moved[np.searchsorted(odd, offs)]
    return out, offs


def places(cps: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each code point of the consistent form of flat code points, the place of its source; and the form's row offsets."""
    size = _take(tables().size, cps, 1).astype(np.int64)
    size[(cps >= 0xE0000) & (cps <= 0xE0FFF)] = 0
    flat, ends = _expand(cps, offs)
    keep = _compose(flat, ends, kept=True)[1]  # a composed mark has no place of its own
    return np.repeat(np.arange(len(cps)), size)[keep], np.concatenate([[0], np.cumsum(keep)])[ends]


def _within(sizes: np.ndarray) -> np.ndarray:
    """0..size-1 for each size, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes)


def _pair(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Composite of two code points, or 0."""
    t = tables()
    key = (first.astype(np.uint64) << np.uint64(21)) | second.astype(np.uint64)
    at = np.minimum(np.searchsorted(t.pair_keys, key), len(t.pair_keys) - 1)
    return np.where(t.pair_keys[at] == key, t.pair_to[at], 0).astype(np.uint32)


def _compose(cps: np.ndarray, offs: np.ndarray, kept: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Marks composed with their bases; the new offsets, or with kept the places that stay."""
    t = tables()
    ccc = _take(t.ccc, cps, 0)
    mark = np.flatnonzero(ccc)
    keep = np.ones(len(cps), bool)
    if len(mark):
        cps = cps.copy()
        row = np.searchsorted(offs, mark, side="right")
        head = np.ones(len(mark), bool)
        head[1:] = (np.diff(mark) != 1) | (np.diff(row) != 0)
        run = np.cumsum(head) - 1
        if not head.all():  # canonical order inside a run of marks
            order = np.lexsort((np.arange(len(mark)), ccc[mark], run))
            cps[mark], ccc[mark] = cps[mark][order], ccc[mark][order]
        first = mark[head]
        base = first - 1
        ok = (base >= 0) & (base >= offs[row[head] - 1])
        base = np.maximum(base, 0)
        length = np.bincount(run)
        last = np.zeros(len(first), np.uint8)
        for k in range(int(length.max())):
            live = np.flatnonzero((length > k) & ok)
            at, b = first[live] + k, base[live]
            to = _pair(cps[b], cps[at])
            free = (to > 0) & ((last[live] == 0) | (last[live] < ccc[at]))
            cps[b[free]] = to[free]
            keep[at[free]] = False
            last[live[~free]] = ccc[at[~free]]
    if len(cps) and ((cps >= 0x1100) & (cps < 0x1200)).any():
        cps, keep = _hangul(cps.copy(), keep, offs)
    if kept:
        return cps[keep], keep
    if keep.all():
        return cps, offs
    ends = np.zeros(len(cps) + 1, np.int64)
    np.cumsum(keep, out=ends[1:])
    return cps[keep], ends[offs]


def _hangul(cps: np.ndarray, keep: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    row = _rows(offs)
    same = row[1:] == row[:-1]
    lead = np.flatnonzero(same & (cps[:-1] >= 0x1100) & (cps[:-1] <= 0x1112) & (cps[1:] >= 0x1161) & (cps[1:] <= 0x1175))
    cps[lead] = 0xAC00 + ((cps[lead] - 0x1100) * 21 + (cps[lead + 1] - 0x1161)) * 28
    keep[lead + 1] = False
    prior = np.arange(len(cps)) - 1
    prior[1:][~keep[:-1]] -= 1
    tail = np.flatnonzero((cps >= 0x11A8) & (cps <= 0x11C2) & (prior >= 0))
    tail = tail[(row[prior[tail]] == row[tail]) & (cps[prior[tail]] >= 0xAC00) & (cps[prior[tail]] <= 0xD7A3)]
    tail = tail[(cps[prior[tail]] - 0xAC00) % 28 == 0]
    cps[prior[tail]] += cps[tail] - 0x11A7
    keep[tail] = False
    return cps, keep


def consistent(column) -> pa.Array:
    """Arrow string column in consistent form."""
    cps, offs, valid = codepoints(column)
    cps, offs = unify(cps, offs)
    return strings(cps, offs, valid)


@lru_cache(4)
def _powers(n: int, base: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        return np.multiply.accumulate(p)


def _segments(values: np.ndarray, starts: np.ndarray, op=np.add) -> np.ndarray:
    with np.errstate(over="ignore"):
        return op.reduceat(values, starts) if len(starts) else values[:0]


def row_hashes(cps: np.ndarray, offs: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each row's code points."""
    n = np.diff(offs)
    out = np.full(len(n), np.uint64(0x51ED27 + seed), np.uint64)
    full = np.flatnonzero(n)
    if len(full):
        size = max(1024, 1 << int(n.max()).bit_length())
        p = _powers(size, 0x9E3779B97F4A7C15 ^ (2 * seed))
        with np.errstate(over="ignore"):
            v = _splitmix(cps.astype(np.uint64) + np.uint64(seed)) if seed else _take(tables().mix, cps, 7)
            out[full] = _segments(v * p[_within(n[full])], offs[:-1][full]) + n[full].astype(np.uint64)
    return _splitmix(out)


def token_runs(cps: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every token: runs of letters or digits, each Han character alone."""
    kind = _take(tables().kind, cps, 0)
    n = len(cps)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    opens = kind != SEPARATOR
    opens[1:] &= ~((kind[1:] == WORD) & (kind[:-1] == WORD) & ~edge[1:n])
    start = np.flatnonzero(opens)
    stop = kind != SEPARATOR
    stop[:-1] &= ~((kind[1:] == WORD) & (kind[:-1] == WORD) & ~edge[1:n])
    end = np.flatnonzero(stop) + 1
    row = np.searchsorted(offs, start, side="right") - 1
    return start, end, row


def token_hashes(cps: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each token of flat code points."""
    n = end - start
    if not len(n):
        return np.zeros(0, np.uint64)
    flat = np.repeat(start, n) + _within(n)
    p = _powers(max(1024, 1 << int(n.max()).bit_length()), 0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        v = _take(tables().mix, cps[flat], 7) * p[_within(n)]
        return _splitmix(_segments(v, np.concatenate([[0], np.cumsum(n)[:-1]])) + n.astype(np.uint64))


ROW_BITS = 13
ROWS = 1 << ROW_BITS
WORDS = 3


class Shingles:
    """Distinct hashes (51 bits, ascending in each row) of the w-token shingles of up to 8,192 rows.

    rows: the rows with enough tokens; size: their number of distinct shingles; flat: all hashes;
    first: where each row's hashes start in flat.
    """

    def __init__(self, column, width: int, least_tokens: int) -> None:
        cps, offs, _ = codepoints(column)
        cps, offs = unify(cps, offs)
        cps = _take(tables().lower, cps, None)
        start, end, row = token_runs(cps, offs)
        many = np.bincount(row, minlength=len(offs) - 1) >= max(width, least_tokens)
        pick = many[row]
        tok, row = token_hashes(cps, start[pick], end[pick]), row[pick]
        with np.errstate(over="ignore"):
            m = len(tok) - width + 1
            h = np.zeros(max(m, 0), np.uint64)
            for i in range(width if m > 0 else 0):
                h = (h + tok[i : m + i]) * np.uint64(0xD6E8FEB86659FD93)
                h ^= h >> np.uint64(29)
            h = _splitmix(h)
        if m > 0:
            whole = row[:m] == row[width - 1 :]
            key = (row[:m][whole].astype(np.uint64) << np.uint64(64 - ROW_BITS)) | (h[whole] >> np.uint64(ROW_BITS))
            key.sort()
            key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
        else:
            key = np.zeros(0, np.uint64)
        at = (key >> np.uint64(64 - ROW_BITS)).astype(np.int64)
        self.flat = key & np.uint64((1 << (64 - ROW_BITS)) - 1)
        self.rows, self.first, self.size = np.unique(at, return_index=True, return_counts=True)
        self.of = np.repeat(np.arange(len(self.rows)), self.size)

    def signature(self) -> np.ndarray:
        """64-bit identity of each row's set."""
        with np.errstate(over="ignore"):
            return _splitmix(_segments(_splitmix(self.flat), self.first) + self.size.astype(np.uint64))

    def sketch(self) -> np.ndarray:
        """(rows, WORDS) parity bits of each row's set: sets that differ in d shingles differ in at most d bits."""
        bit = self.flat % np.uint64(64 * WORDS)
        one = np.uint64(1) << (bit & np.uint64(63))
        word = bit >> np.uint64(6)
        parts = [_segments(np.where(word == w, one, np.uint64(0)), self.first, np.bitwise_xor) for w in range(WORDS)]
        return np.stack(parts, 1)
