"""Document fingerprints from prefix polynomial hashes.

``PrefixHash`` holds, for every prefix of a text, the polynomial of its code points modulo a prime,
under two bases. Differences of prefixes give the hash of any span, so any two spans compare in
constant time, and the longest common extension of two places is found by binary search.

A fingerprint is read off these arrays: the length, the whole text's hash, the hashes of the
prefixes and suffixes at fixed, geometrically growing lengths, and the ``SPANS`` smallest hashes of
all spans of ``SPAN`` code points. Two fingerprints compare without their texts: binary search over
the prefix and suffix lengths bounds what the texts share at both ends, the span sample estimates what they
share in any order; the likeness is the larger share, 1.0 for equal texts alone.

The successor of a document in the order of ids may lie in another partition. Ids are cut into ranges
of about equal bytes, the first document of every range is sent along with the range before it as well,
and every range is a partition that is read as a stream, one document ahead. Texts are shuffled once.

Defined results: null texts count as empty; empty texts have a fingerprint and are like each other
alone; the only document is its own successor; rows of one id follow each other in the order of
their texts; rows without id come last; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import text as t
from .workers import ship

PRIME = (1 << 31) - 1
BASES = (1_000_003, 2_147_001_325)
SPAN = 24
SPANS = 16
RANGE_BYTES = 32 << 20
MOST_RANGES = 20_000
#: Ranges are cut at quantiles of ids, each id counted once for every so many bytes of its text begun.
WEIGHT_BYTES = 1 << 10
_LOWEST = -(1 << 63)

#: Lengths at which prefixes and suffixes are recorded: four in every doubling.
LENGTHS = np.unique((2.0 ** (np.arange(4 * 39) / 4)).astype(np.int64))

_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse modulo ``PRIME``, at least ``n``; by doubling."""
    if which not in _tables or len(_tables[which][0]) < n:
        made = []
        for base in (BASES[which], pow(BASES[which], -1, PRIME)):
            row = np.ones(1, dtype=np.uint64)
            while len(row) < max(n, 1 << 14):
                row = np.concatenate([row, row * np.uint64(pow(base, len(row), PRIME)) % np.uint64(PRIME)])
            made.append(row)
        _tables[which] = (made[0], made[1])
    up, down = _tables[which]
    return up[:n], down[:n]


class PrefixHash:
    """Prefix arrays of a text."""

    def __init__(self, text: str):
        points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64) + np.uint64(1)
        self.n = len(points)
        self.prefix = []
        for which in range(2):
            total = np.zeros(self.n + 1, dtype=np.uint64)
            up, _ = _powers(which, self.n + 1)
            np.cumsum(points * up[: self.n] % np.uint64(PRIME), out=total[1:])
            self.prefix.append(total % np.uint64(PRIME))

    def spans(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of 62 bits of every span ``begin .. end``."""
        out = []
        for which, prefix in enumerate(self.prefix):
            _, down = _powers(which, self.n + 1)
            out.append((prefix[end] + np.uint64(PRIME) - prefix[begin]) * down[begin] % np.uint64(PRIME))
        # A difference below 2 * PRIME times a power below PRIME stays below 2**63.
        return out[0] << np.uint64(31) | out[1]

    def span(self, begin: int, end: int) -> int:
        found = 0
        for which, prefix in enumerate(self.prefix):
            difference = int(prefix[end]) + PRIME - int(prefix[begin])
            found = found << 31 | difference * int(_powers(which, self.n + 1)[1][begin]) % PRIME
        return found

    def common_extension(self, begin: int, other: PrefixHash, at: int) -> int:
        """Length of the longest common extension of ``begin`` here and ``at`` there."""
        low, high = 0, min(self.n - begin, other.n - at)
        while low < high:
            middle = (low + high + 1) // 2
            if self.span(begin, begin + middle) == other.span(at, at + middle):
                low = middle
            else:
                high = middle - 1
        return low

    def fingerprint(self) -> str:
        """``n:whole:prefixes:suffixes:spans`` in hexadecimal; lists have 6 or 8 digits an entry."""
        lengths = LENGTHS[: np.searchsorted(LENGTHS, self.n, side="right")]
        zero = np.zeros_like(lengths)
        heads, tails = self.spans(zero, lengths), self.spans(self.n - lengths, zero + self.n)
        begin = np.arange(max(0, self.n - SPAN + 1))
        drawn = _smallest(t.mix(self.spans(begin, begin + SPAN)) >> np.uint64(32)) if len(begin) else []
        mask = np.uint64(0xFFFFFF)
        return ":".join(
            [
                f"{self.n:x}",
                f"{self.span(0, self.n):016x}",
                "".join([f"{x:06x}" for x in (t.mix(heads) & mask).tolist()]),
                "".join([f"{x:06x}" for x in (t.mix(tails) & mask).tolist()]),
                "".join([f"{x:08x}" for x in drawn]),
            ]
        )


def _smallest(values: np.ndarray) -> list[int]:
    """The ``SPANS`` smallest distinct values in order."""
    few = values
    if len(values) > 4 * SPANS:
        few = np.partition(values, 4 * SPANS)[: 4 * SPANS]
    found = sorted(set(few.tolist()))
    if len(found) < SPANS and len(few) < len(values):
        found = sorted(set(values.tolist()))
    return found[:SPANS]


def _shared_length(a: str, b: str) -> int:
    """Largest recorded length at which the hashes agree, by binary search (longer ones differ)."""
    low, high = 0, min(len(a), len(b)) // 6
    while low < high:
        middle = (low + high + 1) // 2
        if a[6 * middle - 6 : 6 * middle] == b[6 * middle - 6 : 6 * middle]:
            low = middle
        else:
            high = middle - 1
    return int(LENGTHS[low - 1]) if low else 0


def likeness(a: str, b: str) -> float:
    """Likeness of two fingerprints, 0 to 1; 1.0 only for equal ones."""
    if a == b:
        return 1.0
    x, y = a.split(":"), b.split(":")
    longest = max(int(x[0], 16), int(y[0], 16))
    ends = (_shared_length(x[2], y[2]) + _shared_length(x[3], y[3])) / longest
    p = {x[4][i : i + 8] for i in range(0, len(x[4]), 8)}
    q = {y[4][i : i + 8] for i in range(0, len(y[4]), 8)}
    lowest = sorted(p | q)[:SPANS]
    spans = sum(1 for s in lowest if s in p and s in q) / len(lowest) if lowest else 0.0
    return min(max(ends, spans), longest / (longest + 1))


def edited_text(text: str, following: str) -> str:
    """The last half of ``text`` replaced by as much of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_RESULT = (
    "doc long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double, edited_from long"
)


def _rows(pending: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]
    names = [c.split(" ")[0] for c in _RESULT.split(", ")]
    columns = list(zip(*pending, strict=True)) or [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order; each is finished by the one after it, a ghost closes a range."""
    last: tuple[int | None, str, PrefixHash, str] | None = None
    for piece in t.pieces(batches, "text"):
        done = []
        columns = (piece.column(c).to_pylist() for c in ("doc", "text", "ghost"))
        for doc, text, ghost in zip(*columns, strict=True):
            own = PrefixHash(text or "")
            printed = own.fingerprint()
            if last is not None:
                edited = edited_text(last[1], text or "")
                changed = PrefixHash(edited)
                edited_print = changed.fingerprint()
                done.append(
                    (
                        last[0],
                        last[2].n,
                        hashlib.sha256(edited.encode()).hexdigest(),
                        last[3],
                        edited_print,
                        likeness(last[3], edited_print),
                        likeness(last[3], printed),
                        last[2].common_extension(0, changed, 0),
                    )
                )
            last = None if ghost else (doc, text or "", own, printed)
        yield _rows(done)


def _placed(bounds: np.ndarray) -> Callable:
    @F.pandas_udf("int")
    def place(key: pd.Series) -> pd.Series:
        return pd.Series(len(bounds) - np.searchsorted(bounds, key.to_numpy(), side="left")).astype("int32")

    return place


def fingerprints(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", range_bytes: int = RANGE_BYTES
) -> DataFrame:
    """Per document row its fingerprint, that of its edited text, and likenesses.

    ``edited_from`` is the first code point at which the edited text differs.
    """
    ship(documents.sparkSession)
    doc = F.col(id_col).cast("long")
    rows = documents.select(
        doc.alias("doc"), F.coalesce(doc, F.lit(_LOWEST)).alias("key"), F.col(text_col).alias("text")
    )
    n_bytes = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_ranges = min(MOST_RANGES, 1 + n_bytes // range_bytes)
    shares = [i / n_ranges for i in range(1, n_ranges)]
    weight = (F.coalesce(F.octet_length("text"), F.lit(0)) / WEIGHT_BYTES).cast("int")
    weighed = rows.select("key", F.explode(F.sequence(F.lit(0), weight)))
    bounds = weighed.agg(F.percentile_approx("key", shares, 20 * n_ranges)).first()[0] if shares else []
    place = _placed(np.unique(np.array(bounds or [], dtype=np.int64)))
    ranged = rows.withColumn("range", place("key"))
    # The first document of every range, in the order of ranges: at most MOST_RANGES ids.
    heads = sorted(tuple(r) for r in ranged.groupBy("range").agg(F.max("key")).collect())
    before = [(heads[i][1], heads[i - 1][0]) for i in range(len(heads))]
    spark = documents.sparkSession
    ghosts = rows.join(F.broadcast(spark.createDataFrame(before, "key long, range int")), "key")
    ghosts = ghosts.groupBy("key", "range").agg(F.min("text").alias("text"))
    both = ranged.withColumn("ghost", F.lit(False)).unionByName(
        ghosts.withColumn("ghost", F.lit(True)).withColumn("doc", F.lit(None).cast("long"))
    )
    order = ["range", "ghost", F.desc("key"), F.asc_nulls_last("text")]
    dealt = both.repartitionById(n_ranges, "range").sortWithinPartitions(*order)
    return dealt.select("doc", "text", "ghost").mapInArrow(_stream, _RESULT)
