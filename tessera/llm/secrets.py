"""Operator 7: secret scans: fixed patterns, and a randomness battery under false-discovery control.

Base spans come from three patterns (assignments, access keys, hexadecimal strings) and always
stay.  The battery looks at every run of 20 or more characters of the base64 and base64url
alphabets outside them that has both a digit and a letter; a run with signs of both alphabets is cut
at those of one or the other.  The encoding is the smallest alphabet that holds
the run; its symbols are put to three tests of uniform randomness: chi-squared over the alphabet
(pooled into so many equal cells as the length bears), runs about the median, and serial
correlation at lag one.  The least of the three p-values, times three, says how well structure is
shown.  Within each class of lengths the Benjamini-Hochberg procedure rejects randomness, at a
rate that falls as longer runs give the tests more power; runs that stay unrejected are secrets.
P-values are counted on a fixed grid, so what reaches the driver doesn't grow with the input.

Defined results: a null or empty text has no spans.  Offsets count code points, ends exclusive.
Rows that repeat, also a doc_id, keep a row each, and their runs count each.  Other columns are
carried or ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import materialize, record_batch, slices

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
SHORTEST = 20
RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}")
DIGIT = re.compile(r"[0-9]")
#: A word of ASSIGN, for a quick look before the pattern runs.
WORDS = ("passw", "secret", "token", "api")
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ("assign", "access", "hex", "random")
#: Smallest first; letters of both cases, digits and signs come last.
ALPHABETS = tuple(
    (name, {c: i for i, c in enumerate(symbols)})
    for name, symbols in (
        ("hex", "0123456789abcdef"),
        ("HEX", "0123456789ABCDEF"),
        ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
        ("base36", "0123456789abcdefghijklmnopqrstuvwxyz"),
        ("BASE36", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        ("base62", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"),
        ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
        ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
    )
)
#: Classes of lengths: from, and the false-discovery rate of rejecting randomness there.
LENGTHS = ((20, 0.10), (32, 0.05), (48, 0.02), (96, 0.01))
#: Grid of p-values: steps of a twentieth of a decade down to 1e-30.
GRID = 20
LOWEST = 30 * GRID


def long_words(text: str) -> list[str]:
    """The words that could hold a run or a hexadecimal string: most texts have none, and the
    patterns needn't go over them."""
    return [w for w in text.split() if len(w) >= 20]


def base_spans(text: str, long: list[str] | None = None) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns."""
    out = []
    long = long_words(text) if long is None else long
    folded = text.lower()
    if any(w in folded for w in WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    if any(HEX.search(w) for w in long):
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def _upper_normal(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def _chi2_tail(x: float, df: int) -> float:
    """Wilson-Hilferty approximation."""
    if x <= 0:
        return 1.0
    return _upper_normal(((x / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df)))


def battery(run: str) -> tuple[str, float] | None:
    """Inferred encoding and p-value for structure; None if no alphabet holds the run or it
    lacks digits or letters."""
    body = run
    if not any(c.isdigit() for c in body) or not any(c.isalpha() for c in body):
        return None
    held = set(body)
    for name, index in ALPHABETS:
        if held <= index.keys():
            break
    else:
        return None
    symbols, size, n = [index[c] for c in body], len(index), len(body)
    cells = max(2, min(size, n // 5))
    counts = np.bincount([s * cells // size for s in symbols], minlength=cells)
    weights = np.bincount([s * cells // size for s in range(size)], minlength=cells) / size
    uniform = _chi2_tail(float(((counts - n * weights) ** 2 / (n * weights)).sum()), cells - 1)
    upper = [2 * s >= size for s in symbols]
    n1 = sum(upper)
    n2 = n - n1
    if n1 == 0 or n2 == 0:
        ordered = 2.0 ** (1 - n)
    else:
        runs = 1 + sum(a != b for a, b in zip(upper, upper[1:]))
        mean = 2 * n1 * n2 / n + 1
        spread = math.sqrt(max((mean - 1) * (mean - 2) / (n - 1), 1e-9))
        ordered = 2 * _upper_normal(max(0.0, abs(runs - mean) - 0.5) / spread)
    x = np.array(symbols, float) - np.mean(symbols)
    power = float((x * x).sum())
    serial = 2 * _upper_normal(abs(float((x[1:] * x[:-1]).sum()) / power + 1 / n) * math.sqrt(n)) if power else 0.0
    return name, min(1.0, 3 * min(uniform, min(1.0, ordered), min(1.0, serial)))


def length_class(n: int) -> int:
    return sum(n >= least for least, _ in LENGTHS) - 1


def grid(p: float) -> int:
    """Step of a p-value on the grid, rounded up to the next larger value."""
    return min(LOWEST, int(-math.log10(max(p, 1e-300)) * GRID))


def cutoffs(counts: dict[tuple[int, int], int]) -> list[int]:
    """For each length class the step from which on randomness is rejected (Benjamini-Hochberg on
    the grid); ``counts`` by class and step."""
    out = []
    for k, (_, rate) in enumerate(LENGTHS):
        total = sum(n for (c, _), n in counts.items() if c == k)
        at, cut = 0, LOWEST + 1
        for step in range(LOWEST, -1, -1):
            at += counts.get((k, step), 0)
            if at and 10 ** (-step / GRID) <= rate * at / total:
                cut = step
        out.append(cut)
    return out


SIGNS = (re.compile(r"[^-_]+"), re.compile(r"[^+/]+"))


def _parts(run: str) -> list[tuple[int, int]]:
    """The run, or if it has signs of both base64 alphabets, its stretches of either that are long
    enough; the longest first, none over another."""
    if not (("+" in run or "/" in run) and ("-" in run or "_" in run)):
        return [(0, len(run))]
    found = sorted({m.span() for sign in SIGNS for m in sign.finditer(run) if m.end() - m.start() >= SHORTEST}, key=lambda s: (s[0] - s[1], s))
    out: list[tuple[int, int]] = []
    for a, b in found:
        if all(b <= c or d <= a for c, d in out):
            out.append((a, b))
    return sorted(out)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """(start, end, length class, grid step) of runs for the battery, outside the base spans."""
    out = []
    for m in RUN.finditer(text):
        at, free = m.start(), []
        for a, _, b in base:
            if a < m.end() and m.start() < b:
                free.append((at, a))
                at = max(at, b)
        free.append((at, m.end()))
        for start, end in free:
            if end - start < SHORTEST:
                continue
            for a, b in _parts(text[start:end]):
                found = battery(text[start + a : start + b])
                if found:
                    out.append((start + a, start + b, length_class(b - a), grid(found[1])))
    return out


_FOUND = pa.schema(
    [
        ("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("starts", pa.list_(pa.int64())),
        ("kinds", pa.list_(pa.int32())), ("ends", pa.list_(pa.int64())), ("tried", pa.list_(pa.list_(pa.int64()))),
    ]
)
FOUND = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, starts array<long>, kinds array<int>, ends array<long>, tried array<array<long>>"
DONE = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long"


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Each stretch of overlapping spans becomes the name of its first kind in brackets."""
    out, at = [], 0
    for a, k, b in sorted(spans):
        if a >= at:
            out += [text[at:a], f"[{KINDS[k]}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, *, carry: bool = False) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random; with ``carry`` also row,
    all columns of the document, and redacted, its text with the spans named (null: null)."""
    whole = [F.struct(*docs.columns).alias("row")] if carry else []
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *whole)
    more = [rows.schema["text"], rows.schema["row"]] if carry else []
    found_schema = StructType(StructType.fromDDL(FOUND).fields + more)
    done_schema = StructType(StructType.fromDDL(DONE).fields + ([StructField("redacted", StringType()), rows.schema["row"]] if carry else []))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                out = []
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    long = long_words(text or "")
                    base = base_spans(text or "", long)
                    kinds = [k for _, k, _ in base]
                    tried = candidates(text, base) if any(DIGIT.search(w) for w in long) else []
                    digest = hashlib.sha256(joined(base).encode()).hexdigest()
                    out.append([doc, *(kinds.count(k) for k in range(3)), digest, [a for a, _, _ in base], kinds, [b for _, _, b in base], tried])
                columns = record_batch(_FOUND, *map(list, zip(*out))).columns
                yield pa.RecordBatch.from_arrays([*columns, *([part.column("text"), part.column("row")] if carry else [])], names=found_schema.names)

    found = materialize(rows.mapInArrow(find, found_schema), "spans")
    tried = found.select(F.explode("tried").alias("t")).groupBy(F.col("t")[2].alias("k"), F.col("t")[3].alias("step")).count()
    limits = cutoffs({(r.k, r.step): r["count"] for r in tried.collect()})  # 4 x 601 rows at most

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, n_random, redacted = [], [], []
            texts = batch.column("text").to_pylist() if carry else [None] * batch.num_rows
            for a, k, b, t, text in zip(*(batch.column(c).to_pylist() for c in ("starts", "kinds", "ends", "tried")), texts):
                drawn = [(x[0], 3, x[1]) for x in t if x[3] < limits[x[2]]]
                all_spans = [*zip(a, k, b), *drawn]
                spans.append(joined(all_spans))
                n_random.append(len(drawn))
                redacted.append(None if text is None else redact(text, all_spans) if all_spans else text)
            columns = [*batch.columns[:5], pa.array(spans, pa.string()), pa.array(n_random, pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, *([pa.array(redacted, pa.string()), batch.column("row")] if carry else [])], names=done_schema.names)

    return found.mapInArrow(decide, done_schema)


def without_secrets(docs: DataFrame) -> DataFrame:
    """The documents, all columns, with the secrets in their texts named in brackets."""
    found = scan(docs, carry=True)
    return found.select(*(F.col("redacted").alias("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns))
