"""Fill-in-the-middle: texts cut in three, with the middle moved behind prefix and suffix, and back again.

Method: texts stay UTF-8 bytes. A sparse index of exceptions holds, for each character of more than one byte, its
position and its excess bytes, summed; a binary search in it turns cuts counted in code points into cuts in bytes and
back. Stretches of ASCII have no entry and cost arithmetic only. Cuts lie between units: lines (with their newline) or
single code points.

The three cuts and the form come from a hash of the seed and doc_id, so a task that runs again, and a row that is
repeated, gets the same ones.

Defined results: a null or empty text has no units and stays plain (as an empty text). A text that contains a marker
stays plain, since it could not be told apart from a transformed one. A null doc_id hashes like an empty one. Rows are
transformed one by one: repeated rows give repeated results, an empty table gives none. Columns of the input other than
doc_id and text are not looked at.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from itertools import permutations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.words import rows_of

SEED = 7
_SCHEMA = "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output binary"


class CharIndex:
    """Code points of a UTF-8 text and their bytes, by its multibyte characters alone."""

    def __init__(self, data: bytes):
        raw = np.frombuffer(data, np.uint8)
        # Where multibyte characters start, and the bytes beyond one that all up to and including each of them have.
        self.at = np.flatnonzero(raw >= 0xC0)
        lead = raw[self.at]
        self.excess = np.cumsum(1 + (lead >= 0xE0) + (lead >= 0xF0), dtype=np.int64)
        # The same positions counted in code points.
        self.points = self.at - np.concatenate([np.zeros(1, np.int64), self.excess])[:-1]
        self.n_bytes = len(data)
        self.n_chars = len(data) - (int(self.excess[-1]) if len(self.excess) else 0)

    def _before(self, sorted_at: np.ndarray, cuts) -> np.ndarray:
        k = np.searchsorted(sorted_at, cuts, side="left")
        return np.where(k > 0, self.excess[np.maximum(k, 1) - 1] if len(self.excess) else 0, 0)

    def to_bytes(self, cuts) -> np.ndarray:
        """Cuts between code points as cuts between bytes."""
        cuts = np.asarray(cuts, np.int64)
        return cuts + self._before(self.points, cuts)

    def to_chars(self, cuts) -> np.ndarray:
        """Cuts between bytes, at the borders of characters, as cuts between code points."""
        cuts = np.asarray(cuts, np.int64)
        return cuts - self._before(self.at, cuts)


@dataclass(frozen=True)
class Rule:
    """What is done to a text: units, shares in percent, and markers of prefix, suffix and middle."""

    unit: str = "line"
    seed: int = SEED
    transformed: int = 100
    suffix_first: int = 50
    prefix: bytes = b"<P>"
    suffix: bytes = b"<S>"
    middle: bytes = b"<M>"

    def __post_init__(self):
        if self.unit not in ("line", "char"):
            raise ValueError(f"unknown unit {self.unit}")
        # No marker may hold another, nor end as one starts: else one could be found across a border.
        for a, b in product(self.marks, repeat=2):
            if not a or any(a[-k:] == b[:k] for k in range(1, min(len(a), len(b)))):
                raise ValueError("markers overlap")
        if any(a in b for a, b in permutations(self.marks, 2)):
            raise ValueError("markers overlap")

    @property
    def marks(self) -> tuple[bytes, bytes, bytes]:
        return self.prefix, self.suffix, self.middle

    def draws(self, doc_id: int | None) -> list[int]:
        """Four numbers below 2**32 for a document."""
        found = hashlib.sha256(f"{self.seed}:{'' if doc_id is None else doc_id}".encode()).digest()
        return [int.from_bytes(found[i : i + 4], "big") for i in range(0, 16, 4)]


def cuts_of(data: bytes, rule: Rule, first: int, second: int) -> tuple[int, np.ndarray, np.ndarray]:
    """The number of units, and the ends of prefix and middle in bytes and in code points."""
    index = CharIndex(data)
    if rule.unit == "char":
        n = index.n_chars
        points = np.array(sorted((first % (n + 1), second % (n + 1))), np.int64)
        return n, index.to_bytes(points), points
    ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 10) + 1
    if len(data) and (not len(ends) or ends[-1] < len(data)):
        ends = np.append(ends, len(data))
    n = len(ends)
    cuts = np.concatenate([np.zeros(1, np.int64), ends])[sorted((first % (n + 1), second % (n + 1)))]
    return n, cuts, index.to_chars(cuts)


def transformed(doc_id: int | None, data: bytes, rule: Rule) -> tuple[int, str, int | None, int | None, bytes]:
    """n, form, prefix_chars, middle_chars and output of one text."""
    first, second, third, fourth = rule.draws(doc_id)
    n, (a, b), points = cuts_of(data, rule, first, second)
    if not data or third % 100 >= rule.transformed or any(mark in data for mark in rule.marks):
        return n, "plain", None, None, data
    prefix, middle, suffix = data[:a], data[a:b], data[b:]
    if fourth % 100 < rule.suffix_first:
        form, output = "spm", rule.suffix + suffix + rule.prefix + prefix + rule.middle + middle
    else:
        form, output = "psm", rule.prefix + prefix + rule.suffix + suffix + rule.middle + middle
    return n, form, int(points[0]), int(points[1] - points[0]), output


def restored(form: str | None, output: bytes, rule: Rule) -> bytes:
    """The text that an output was made of."""
    if form not in ("psm", "spm"):
        return output
    one, two = (rule.prefix, rule.suffix) if form == "psm" else (rule.suffix, rule.prefix)
    if not output.startswith(one):
        raise ValueError(f"an output in form {form} starts with its first marker")
    head, _, rest = output[len(one) :].partition(two)
    tail, _, middle = rest.partition(rule.middle)
    prefix, suffix = (head, tail) if form == "psm" else (tail, head)
    return prefix + middle + suffix


def fill_middle(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """doc_id, n (units), form (plain, psm, spm), prefix_chars, middle_chars and output (UTF-8) for every row."""

    def batches(rows):
        for batch in rows_of(rows):
            ids, texts = batch.column("doc_id"), batch.column("text").to_pylist()
            found = [transformed(i, text, rule) for i, text in zip(ids.to_pylist(), texts, strict=True)]
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())
            columns = [pa.array(column, kind) for column, kind in zip(zip(*found, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([ids, *columns], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return texts.mapInArrow(batches, _SCHEMA)


def restore(rows: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """The rows of `fill_middle` with `text`, rebuilt from output and form alone. A null output gives an empty text."""

    def batches(parts):
        for batch in rows_of(parts):
            pairs = zip(batch.column("form").to_pylist(), batch.column("output").to_pylist(), strict=True)
            texts = pa.array([restored(form, output or b"", rule) for form, output in pairs], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=[*batch.schema.names, "restored"])

    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    found = rows.select(*names).mapInArrow(batches, f"{_SCHEMA}, restored binary")
    return found.select(*names, F.col("restored").cast("string").alias("text"))


def op12_fill_middle(spark, sf_dir):
    rows = restore(fill_middle(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    digest = [F.sha2(F.col(c).cast("binary"), 256).alias(name) for c, name in (("output", "output_sha256"), ("text", "restored_sha256"))]
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digest)


SQL = """
WITH drawn AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
counted AS (
  SELECT doc_id, text, length(text) - length(replace(text, chr(10), '')) + CAST(text <> '' AND right(text, 1) <> chr(10) AS BIGINT) AS n,
    CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[25:32] AS BIGINT) AS h4
  FROM drawn),
placed AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b, string_split(text, chr(10)) AS lines FROM counted),
heads AS (
  SELECT *, CASE WHEN a = n THEN text ELSE array_to_string(list_append(lines[1:a], ''), chr(10)) END AS p,
    CASE WHEN b = n THEN text ELSE array_to_string(list_append(lines[1:b], ''), chr(10)) END AS pm
  FROM placed),
parts AS (
  SELECT *, substr(text, length(p) + 1, length(pm) - length(p)) AS m, substr(text, length(pm) + 1) AS s,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM heads)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
"""
