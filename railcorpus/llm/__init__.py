"""Operators for training-data pipelines (tagged llm).

Nothing outside this subpackage imports it; deleting the folder leaves the rest of the library whole.
"""
