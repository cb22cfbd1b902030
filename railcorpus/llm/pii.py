"""Personal information inside free text (problem 1), by bootstrapped contextual extraction.

One pass over the texts, in consistent form, takes out candidates by loose shapes: digit groups, mail-like strings, numbered
streets, words beside a known given name or a title, Chinese surnames with what follows. Each candidate is an instance
(a number's shape, a mail domain, a street type, a surname, a given-name character) met in patterns (the words around it).
Spark scores the graph of patterns and instances in rounds: seed instances make patterns reliable, reliable patterns
make unseen instances reliable, and so on. A candidate is accepted by its patterns or by its instance.

Null and empty texts hold nothing. Ids may repeat; a post has a kind once.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railcorpus.llm import textform
from railcorpus.llm.arrows import chunks
from railcorpus.session import ensure_checkpoint_dir

# Seeds. Words that stand before a family name, for streets, and patterns that introduce a kind.
TITLES = "mr mrs ms miss dr prof sr sra srta"
STREETS = "street road avenue lane"
CALLES = "calle c/ avenida avda avda. paseo ronda camino"
INTRODUCE = {
    "name_han": ("L2我叫", "L2名叫", "L2姓名", "L2系人"),
    "id_number": ("L1ssn", "L1dni", "L1passport", "L1pasaporte", "L2passport no", "L2national id", "L2证号", "L2证件"),
    "phone": ("L1tel", "L1phone", "L1mobile", "L1whatsapp", "L2电话", "L2手机"),
}

SEEN = 3.0  # good candidates that a seed pattern brings with it: soon outweighed by what a large collection shows

PHONES = ("(3d) 3d-4d", "3d-3d-4d", "3d.3d.4d")

# By class: weight of unknown instances against a pattern; share of reliable candidates from which an instance supports patterns;
# from which it is accepted in any context; below which it is accepted in none.
RULES = {
    "phone": (0.15, 0.5, 0.6, 0.0),
    "id_number": (0.15, 0.5, 0.6, 0.0),
    "email": (0.0, 0.5, 0.5, 0.0),
    "address": (0.3, 0.5, 0.5, 0.5),
    "name": (0.3, 0.5, 0.5, 0.3),
    "name_han": (1.0, 0.1, 0.5, 0.0),
}

SPLIT = "\x1e"
DATE = r"(?:19|20)\d\d-\d\d-\d\d"
NUMBER = re.compile(
    rf"(?<![A-Za-z0-9_/])(?!{DATE})(?:\+?\(?\d{{1,24}}\)?(?:(?:[ .-]|(?<=\)) ?)(?!{DATE})\(?\d{{1,24}}\)?){{0,5}}[xX]?|[A-Za-z]-?\d{{7,8}}-?[A-Za-z]?|\d{{8}}-?[A-Za-z])(?![A-Za-z0-9_])"
)
MAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@((?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,})")
HIDDEN_MAIL = re.compile(
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+ ?([\[({<] ?[A-Za-z@]{1,8} ?[\])}>]| at | arroba ) ?([A-Za-z0-9-]+(?:(\.| dot | punto | ?[\[({] ?[A-Za-z.]{1,6} ?[\])}] ?)[A-Za-z0-9-]+)(?:\3[A-Za-z0-9-]+)*)"
)
STREET = re.compile(r"(?<![\w:.-])(?:no\. ?)?\d{1,5}[A-Za-z]?,? (?:[NSEWnsew]\. ?)?([^\W\d_]{3,}) ([^\W\d_]{2,9})(?![^\W_])")
CALLE = re.compile(rf"(?i)(?<!\w)({'|'.join(map(re.escape, CALLES.split()))}) ?([^\W\d_]{{3,}}(?: [^\W\d_]{{3,}})?),? (?:n[.o]{{0,2}} ?)?\d{{1,5}}(?!\w)")
LU = re.compile(r"([一-鿿]{1,4}?)(路|街|巷|弄|胡同|大道)(?:\d{1,5}弄)?\d{1,5}号(?![线口车站])")
WORD = re.compile(r"[^\W\d_]+|#")
HAN = re.compile(r"[一-鿿]")
KINDS = ("phone", "id_number", "email", "address", "name")
CLASSES = ("phone", "id_number", "email", "address", "name", "name_han")


def shape(number: str) -> str:
    """A number's outline: lengths of its digit groups, its separators, A for letters."""
    return re.sub(r"\d+", lambda m: f"{len(m.group())}d", re.sub(r"[A-Za-z]", "A", number))


def _around(text: str, start: int, end: int) -> list[str]:
    """Patterns of a span: one and two words before it, two after; of Chinese, the characters."""
    left = text[max(0, start - 32) : start].rpartition(SPLIT)[2].lower()
    right = text[end : end + 28].partition(SPLIT)[0].lower()
    near = left.rstrip(" :：,，.。-(<\"'")
    out = []
    if near and HAN.match(near[-1]):
        out += ["L2" + near[-2:], "L3" + near[-3:]]
    else:
        words = WORD.findall(left)[-2:]
        if words:
            out.append("L1" + words[-1])
        if len(words) == 2:
            out.append("L2" + " ".join(words))
    after = right.lstrip(" ,，.。!")
    if after and HAN.match(after[0]):
        out.append("R2" + after[:2])
    else:
        words = WORD.findall(right)[:2]
        if len(words) == 2:
            out.append("R2" + " ".join(words))
    return out


class Finder:
    """Candidates of a batch of texts: (row, start, end, class, instance, seed, patterns)."""

    def __init__(self, names: list[tuple[str, str]]) -> None:
        given = sorted({n for n, r in names if r == "given" and not HAN.search(n)})
        self.family = {n for n, r in names if r == "family" and not HAN.search(n)}
        han = "".join(sorted({n for n, r in names if r == "family" and HAN.search(n)}))
        g, t = "|".join(map(re.escape, given)) or r"(?!)", "|".join(TITLES.split())
        before, after = r"(?<![\w@.+#/-])", r"(?![\w@]|[.+_-]\w|[\[(])"
        self.latin = re.compile(rf"(?i){before}(?:(?:{g})(?: [^\W\d_]\.)? ([^\W\d_]{{4,}})|([^\W\d_]{{4,}}), (?:{g})|(?:{t})\.? ([^\W\d_]{{4,}})){after}")
        self.han = re.compile(rf"[{han}]([一-鿿])([一-鿿]?)") if han else None

    def numbers(self, text: str):
        for m in NUMBER.finditer(text):
            s = m.group()
            digits = sum(map(str.isdigit, s))
            if digits < 7:
                continue
            node = shape(s)
            plain = re.sub(r"[ .-]", "", s)
            sure_phone = s[0] == "+" and 10 <= digits <= 15 or node in PHONES
            sure_id = bool(re.fullmatch(r"\d{6}(?:19|20)\d\d(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])\d{3}[\dXx]", plain)) or node == "3d-2d-4d"
            if sure_id and node != "3d-2d-4d":
                node = "national"
            around = _around(text, m.start(), m.end())
            yield m.start(), m.end(), "phone", node, 1.0 if sure_phone else 0.0 if sure_id else -1.0, around
            yield m.start(), m.end(), "id_number", node, 1.0 if sure_id else 0.0 if sure_phone else -1.0, around

    def mails(self, text: str):
        for m in MAIL.finditer(text):
            yield m.start(), m.end(), "email", m.group(1).lower(), 1.0, ["S@"]
        for m in HIDDEN_MAIL.finditer(text):
            sep, dot = re.sub(r"\W", "", m.group(1).lower()), re.sub(r"[\[(){}\]]", "", m.group(3).lower()).strip()
            bare = m.group(1)[0] == " "
            if bare and dot == ".":
                continue
            yield m.start(), m.end(), "email", m.group(2).lower().replace(m.group(3).lower(), "."), -1.0, [f"S{'' if bare else '('}{sep}"]

    def streets(self, text: str):
        for m in STREET.finditer(text):
            kind = m.group(2).lower()
            if not (m.group(1)[0].isupper() or kind in STREETS.split() or text[m.start()] in "nN"):
                continue
            yield m.start(), m.end(), "address", kind, 1.0 if kind in STREETS.split() else -1.0, ["N" + m.group(1).lower(), *_around(text, m.start(), m.end())[:-1]]
        for m in CALLE.finditer(text):
            yield m.start(), m.end(), "address", m.group(1).lower(), 1.0, ["N" + m.group(2).lower()]
        for m in LU.finditer(text):
            yield m.start(), m.end(), "address", m.group(2), 1.0, ["N" + m.group(1)]

    def names(self, text: str):
        at = 0
        while m := self.latin.search(text, at):
            at = m.end() if m.group(1) or m.group(3) else m.start() + 1
            word = (m.group(1) or m.group(2) or m.group(3)).title()
            yield m.start(), m.end(), "name", word.lower(), 1.0 if word in self.family else -1.0, _around(text, m.start(), m.end())
        for m in self.han.finditer(text) if self.han else ():
            left = text[max(0, m.start() - 4) : m.start()].rpartition(SPLIT)[2].rstrip(":： ")[-2:]
            right = [f"R{k}" + text[m.start() + k + 1 : m.start() + k + 3].partition(SPLIT)[0] for k in (1, 2)]
            yield m.start(), m.end(), "name_han", m.group(1), -1.0, (["L2" + left] if left else []) + [r for r in right if len(r) == 4]

    def all(self, text: str):
        for part in (self.numbers, self.mails, self.streets, self.names):
            yield from part(text)


def _joined(column):
    """A batch's texts in consistent form in one string, rows apart by SPLIT; starts of the rows; source row offsets and, for every
    code point of the string, its place in the source."""
    cps, offs, _ = textform.codepoints(column)
    form, new = textform.unify(cps, offs)
    form = np.where((form >= 0x2012) & (form <= 0x2013), np.uint32(0x2D), form)  # figure and short dashes inside numbers
    flat = np.insert(form, new[1:], ord(SPLIT))
    return flat.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass"), new[:-1] + np.arange(len(new) - 1)


def candidates(posts: DataFrame, names: list[tuple[str, str]]) -> DataFrame:
    """(id, start, end, class, node, seed, patterns) of posts (id, text); start and end count code points of the consistent form."""

    def run(batches):
        find = Finder(names)
        for batch in chunks(batches, 2048):
            text, starts = _joined(batch.column(1))
            found = list(find.all(text))
            if not found:
                continue
            at = np.array([f[0] for f in found])
            row = np.searchsorted(starts, at, side="right") - 1
            out = {"id": batch.column(0).take(pa.array(row)), "start": pa.array(at - starts[row], pa.int32()), "end": pa.array(np.array([f[1] for f in found]) - starts[row], pa.int32())}
            for k, name in enumerate(("class", "node", "seed", "patterns"), 2):
                out[name] = pa.array([f[k] for f in found])
            yield pa.RecordBatch.from_pydict(out)

    return posts.select("id", F.col("text").cast("string")).mapInArrow(run, "id string, start int, end int, class string, node string, seed double, patterns array<string>")


def score(found: DataFrame, rounds: int = 8, least: float = 0.6) -> DataFrame:
    """(class, node, patterns, context, share) of the accepted candidates.

    A pattern's score is the share of its candidates whose instance is a seed or already supported; instances sure to be, or supported
    as, of another kind count against it, unknown ones by the class's weight (fully for words behind, which are mostly the next
    sentence's); a pattern met only once or twice, with one instance, counts less. A
    candidate's context is its best pattern. An instance's share is that of its candidates in reliable context. Patterns in
    INTRODUCE are reliable in the first round; from then on they count SEEN good candidates more than the data show. Rounds end when no instance changes
    sides, at most after `rounds`.
    """
    spark = found.sparkSession
    ensure_checkpoint_dir(spark)
    rules = F.broadcast(spark.createDataFrame([(k, *v) for k, v in RULES.items()], "class string, w double, supports double, accepts double, floor double"))  # six rows
    seen = found.groupBy("class", "node", "patterns").agg(F.count("*").alias("n"), F.max("seed").alias("seed")).persist(StorageLevel.MEMORY_AND_DISK)
    edges = seen.select("class", "node", "n", F.explode("patterns").alias("pattern")).groupBy("class", "node", "pattern").agg(F.sum("n").alias("n")).persist(StorageLevel.MEMORY_AND_DISK)
    nodes = seen.groupBy("class", "node").agg(F.max("seed").alias("seed")).withColumn("share", F.greatest("seed", F.lit(0.0))).withColumn("good", F.col("seed") > 0)
    sure = F.lit(False)
    for kind, patterns in INTRODUCE.items():
        sure = sure | (F.col("class") == kind) & F.col("pattern").isin(*patterns)
    context = before = None
    other = F.when(F.col("class") == "phone", "id_number").when(F.col("class") == "id_number", "phone")
    for turn in range(rounds):
        rival = nodes.where("good").select(other.alias("class"), "node", F.lit(True).alias("rival")).where("class is not null")
        met = edges.join(nodes, ["class", "node"]).join(rival, ["class", "node"], "left").withColumn("against", (F.col("seed") == 0) | F.coalesce("rival", F.lit(False)) & ~F.col("good"))
        rated = met.groupBy("class", "pattern").agg(
            F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("pos"), F.sum(F.when(F.col("against"), F.col("n")).otherwise(0)).alias("neg"), F.sum("n").alias("n"), F.count_if("good").alias("kinds")
        ).join(rules, "class")
        unknown = F.when(F.col("pattern").startswith("R"), 1.0).otherwise(F.col("w")) * (F.col("n") - F.col("pos") - F.col("neg"))
        prior = F.when(sure, SEEN).otherwise(0.0)
        share = (F.col("pos") + prior) / (F.col("pos") + F.col("neg") + unknown + 0.3 + prior)
        single = ~F.col("pattern").startswith("S") & (F.col("kinds") < 2) & (F.col("pos") < 3) & ~sure
        rated = rated.select("class", "pattern", F.when(sure & F.lit(turn == 0), 1.0).otherwise(share * F.when(single, 0.85).otherwise(1.0)).alias("p"))
        context = seen.withColumn("pattern", F.explode_outer("patterns")).join(rated, ["class", "pattern"], "left").groupBy("class", "node", "patterns", "n", "seed").agg(F.coalesce(F.max("p"), F.lit(0.0)).alias("context"))
        context = context.checkpoint()
        firm = F.sum(F.when(F.col("context") >= least, F.col("n")).otherwise(0))
        nodes = context.groupBy("class", "node").agg(F.max("seed").alias("seed"), firm.alias("firm"), (firm / F.sum("n")).alias("share")).join(rules, "class")
        known = F.col("seed") >= 0
        nodes = nodes.select("class", "node", "seed", F.when(known, F.col("seed")).otherwise(F.col("share")).alias("share"), F.when(known, F.col("seed") > 0).otherwise((F.col("firm") > 1) & (F.col("share") >= F.col("supports"))).alias("good"))
        after = nodes.where("good").agg(F.count("*"), F.sum(F.xxhash64("class", "node").cast("decimal(20,0)"))).first()
        if turn and after == before:  # the next round would give the same
            break
        before = after
    scored = context.join(nodes.select("class", "node", "share"), ["class", "node"]).join(rules, "class")
    fits = (F.col("context") >= least) & (F.col("share") >= F.col("floor")) | (F.col("share") >= F.col("accepts"))
    return scored.where((F.col("seed") != 0) & fits).select("class", "node", "patterns", "context", "share")


def entities(posts: DataFrame, names: list[tuple[str, str]], rounds: int = 8) -> DataFrame:
    """(id, start, end, kind) of what is accepted."""
    found = candidates(posts, names).persist(StorageLevel.MEMORY_AND_DISK)
    good = score(found, rounds)
    best = found.join(good, ["class", "node", "patterns"])
    kind = F.regexp_replace("class", "_han$", "")
    # a number that both contexts accept is of the better kind
    out = best.select("id", "start", "end", kind.alias("kind"), (F.greatest("context", "share")).alias("sure"))
    return out.groupBy("id", "start", "end").agg(F.max_by("kind", F.struct("sure", "kind")).alias("kind"))


def known_names(df: DataFrame, most: int = 100_000) -> list[tuple[str, str]]:
    """The seed list (name, role) on the driver; a list longer than `most` is refused."""
    rows = df.where("name is not null and role is not null").select("name", "role").distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError("too many seed names")
    return sorted((r["name"], r["role"]) for r in rows)


def redact(posts: DataFrame, spans: DataFrame) -> DataFrame:
    """Posts (id, text) with each span replaced by its kind in brackets; all other characters stay as they were. Of spans that overlap
    the first counts."""
    marks = spans.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "kind"))).alias("spans"))
    return _marked(posts.select("id", F.col("text").cast("string").alias("text")).join(marks, "id", "left"))


def redacted(posts: DataFrame, names: list[tuple[str, str]], rounds: int = 8) -> DataFrame:
    """Posts (id, text) with typed placeholders for what is found in them. Every row stays, also where ids are null or repeated with
    different texts: spans belong to the text, not to the id."""
    keyed = posts.select("id", F.col("text").cast("string").alias("text"), F.sha2("text", 256).alias("key"))
    spans = entities(keyed.select(F.col("key").alias("id"), "text"), names, rounds)
    marks = spans.groupBy(F.col("id").alias("key")).agg(F.array_sort(F.collect_list(F.struct("start", "end", "kind"))).alias("spans"))
    return _marked(keyed.join(marks, "key", "left").select("id", "text", "spans"))


def _marked(rows: DataFrame) -> DataFrame:
    """(id, text) of rows (id, text, spans sorted by start), the spans of a batch replaced in its flat code points."""

    def run(batches):
        for batch in chunks(batches, 2048):
            column = batch.column(2)
            row = np.asarray(pc.list_parent_indices(column)).astype(np.int64)
            if not len(row):
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.string())], ["id", "text"])
                continue
            cps, offs, valid = textform.codepoints(batch.column(1))
            place, ends = textform.places(cps, offs)
            place = np.append(place, len(cps))
            start, end, kind = pc.list_flatten(column).flatten()
            a, stop = ends[row] + start.to_numpy(), ends[row] + end.to_numpy()
            a, b = place[a], np.where(stop < ends[row + 1], place[np.minimum(stop, len(place) - 1)], offs[row + 1])
            live = np.flatnonzero(b > a)
            while len(live):  # a span that begins inside the one before it goes; rarely more than one round
                clash = np.zeros(len(live), bool)
                clash[1:] = (row[live[1:]] == row[live[:-1]]) & (a[live[1:]] < b[live[:-1]])
                clash[1:] &= ~clash[:-1]
                if not clash.any():
                    break
                live = live[~clash]
            row, a, b = row[live], a[live], b[live]
            marks = [np.frombuffer(f"[{k}]".encode("utf-32-le"), "<u4") for k in kind.take(pa.array(live)).to_pylist()]
            size = np.array([len(m) for m in marks], np.int64)
            depth = np.zeros(len(cps) + 1, np.int64)
            depth[a] += 1
            depth[b] -= 1
            keep = np.cumsum(depth[:-1]) == 0
            before = np.concatenate([[0], np.cumsum(keep)])
            new = np.insert(cps[keep], np.repeat(before[a], size), np.concatenate(marks)) if marks else cps
            added = np.concatenate([[0], np.cumsum(np.bincount(row, weights=size, minlength=batch.num_rows)).astype(np.int64)])
            yield pa.RecordBatch.from_arrays([batch.column(0), textform.strings(new, before[offs] + added, valid)], ["id", "text"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, text string")
