"""A mixture of sources in given shares of tokens: entropy balancing, then rounding into copies."""

from __future__ import annotations

import base64
import math
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from weft.storage import Scratch

TOKENIZERS = "/opt/tokenizers"
#: Sources that a mixture may have; the driver keeps a few numbers of each and they are sent to every task.
MAX_SOURCES = 10_000


def source_key(c: Column) -> Column:
    """A source's name without regard to case, blanks and separators; null stays null."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"^[\s\p{Z}_\-]+|[\s\p{Z}_\-]+$", ""), r"[\s\p{Z}_\-]+", "_")


def count_tokens(documents: DataFrame, tokenizers: str = TOKENIZERS, ranks_file: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """doc_id, source, tokens: whole texts in tokens of a public byte-level BPE. Null and empty texts have 0 tokens.

    The driver reads the vocabulary and sends it to the tasks (about a megabyte), so executors need no copy of it.
    """
    with open(os.path.join(tokenizers, ranks_file), "rb") as f:
        vocabulary = documents.sparkSession.sparkContext.broadcast(f.read())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.value.splitlines())}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # fixed: the vocabulary's own splitting
        own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            n = [len(own.encode_ordinary(t)) if t else 0 for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], ["doc_id", "source", "tokens"])

    return documents.select("doc_id", "source", "text").mapInArrow(scan, "doc_id long, source string, tokens long")


class Mixture:
    """Rates and copies of documents such that each source has its share of all tokens.

    Every document starts with the rate at which the whole corpus would give the wanted total. Of all rates between 0
    and max_repeats that meet the token constraints, those nearest to it in (Fermi) entropy are exponential tilts:
    rate / (cap - rate) = start / (cap - start) * exp(m_s * tokens / mean tokens of the source). The multipliers m_s
    come from the convex dual, whose gradient and curvature are one aggregate over all documents in each of Newton's
    iterations, kept inside a bracket, for all sources at once.
    The dual falls apart by source once the total is fixed. The total is ``fill`` of the largest one that the caps
    allow. Copies are floor or ceiling of the rate: along documents ordered by length the running sum of rates is
    rounded, so that any stretch of lengths is off by less than one copy and no cap is passed. A large source is cut by
    a hash into pieces of about ``piece_rows`` documents for this, so no task orders a whole source.

    Sources without a target, null sources and empty texts get no copies and no row. A target whose source has no
    tokens is reported with an actual share of 0 and left out of the balance, the other shares keeping their proportions.
    Targets that are null or not above 0 count as absent. Null doc_ids are kept as they are; of repeated rows each is a
    document. max_repeats that is null counts as 1.
    """

    def __init__(self, documents: DataFrame, targets: DataFrame, fill: float = 0.95, tokenizers: str = TOKENIZERS, piece_rows: int = 20_000, tolerance: float = 1e-9):
        spark = documents.sparkSession
        self.spark, self.piece_rows, self.fill, self.tolerance = spark, piece_rows, fill, tolerance
        scratch = Scratch(spark, "mixture")
        self.targets = targets.where(F.col("source_name").isNotNull()).groupBy(source_key(F.col("source_name")).alias("source_name")).agg(
            F.max("target_share").alias("target_share"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("max_repeats")
        )
        counted = count_tokens(documents, tokenizers).withColumn("source", source_key(F.col("source")))
        if self.targets.count() > MAX_SOURCES:
            raise ValueError(f"a mixture of more than {MAX_SOURCES} sources")
        wanted = F.broadcast(self.targets.where("target_share > 0 AND max_repeats > 0"))  # checked: at most MAX_SOURCES rows
        self.rows = scratch.write(counted.join(wanted, F.col("source") == F.col("source_name")).where("tokens > 0").select("doc_id", "source_name", "tokens", "max_repeats"))
        self.lengths: dict[str, float] = {}
        self.pieces: dict[str, int] = {}
        self.starts: dict[str, float] = {}
        self.multipliers = self._balance()

    def _balance(self) -> dict[str, float]:
        stats = {r.source_name: r for r in self.rows.groupBy("source_name").agg(F.sum("tokens").alias("t"), F.max("max_repeats").alias("cap"), F.max("tokens").alias("longest"), F.avg("tokens").alias("mean"), F.count(F.lit(1)).alias("n")).collect()}
        share = {r.source_name: r.target_share for r in self.targets.collect() if r.source_name in stats}
        if not stats:
            return {}
        whole = sum(share.values())
        share = {s: x / whole for s, x in share.items()}
        total = self.fill * min(stats[s].cap * stats[s].t / share[s] for s in stats)
        goal = {s: total * share[s] for s in stats}
        self.lengths = {s: float(stats[s].mean) for s in stats}
        self.pieces = {s: 1 + stats[s].n // self.piece_rows for s in stats}
        everything = sum(x.t for x in stats.values())
        for s in stats:
            p = min(max(total / everything / stats[s].cap, 1e-6), 0.5)
            self.starts[s] = math.log(p / (1 - p))
        m = dict.fromkeys(stats, 0.0)
        bracket = {s: [-math.inf, math.inf] for s in stats}
        slope = F.col("tokens") / F.col("mean")
        for _ in range(60):
            rated = self._rated(m).groupBy("source_name").agg(
                F.sum(F.col("rate") * F.col("tokens")).alias("g"), F.sum(F.col("rate") * (1 - F.col("rate") / F.col("max_repeats")) * F.col("tokens") * slope).alias("h")
            )
            got = {r.source_name: r for r in rated.collect()}
            off = {s: got[s].g - goal[s] for s in stats}
            if all(abs(off[s]) <= self.tolerance * goal[s] for s in stats):
                break
            for s in stats:
                low, high = bracket[s] = [m[s], bracket[s][1]] if off[s] < 0 else [bracket[s][0], m[s]]
                step = off[s] / got[s].h if got[s].h > 0 else math.copysign(math.inf, off[s])
                to = m[s] - max(-4.0, min(4.0, step))
                m[s] = to if low < to < high else (low + high) / 2 if math.isfinite(low + high) else to
        return m

    def _rated(self, multipliers: dict[str, float]) -> DataFrame:
        if not multipliers:
            return self.rows.withColumns({"rate": F.lit(0.0), "pieces": F.lit(1), "mean": F.lit(1.0)})
        known = self.spark.createDataFrame([(s, x, self.starts[s], self.lengths[s], self.pieces[s]) for s, x in multipliers.items()], "source_name string, m double, start double, mean double, pieces long")
        tilt = F.col("start") + F.col("m") * F.col("tokens") / F.col("mean")
        return self.rows.join(F.broadcast(known), "source_name").withColumn("rate", F.col("max_repeats") / (1 + F.exp(F.greatest(F.lit(-60.0), F.least(F.lit(60.0), -tilt)))))

    def drawn(self) -> DataFrame:
        """doc_id, source_name, tokens, rate, copies of every document of a wanted source."""
        rated = self._rated(self.multipliers)
        piece = F.pmod(F.xxhash64("doc_id"), F.col("pieces"))
        w = W.partitionBy("source_name", "piece").orderBy("tokens", "doc_id").rowsBetween(W.unboundedPreceding, 0)
        start = F.pmod(F.xxhash64("source_name", "piece"), F.lit(1 << 20)) / float(1 << 20)
        upto = rated.withColumn("piece", piece).withColumn("upto", F.sum("rate").over(w) + start)
        copies = F.floor(F.col("upto")) - F.floor(F.col("upto") - F.col("rate"))
        return upto.select("doc_id", "source_name", "tokens", "rate", F.least(copies, F.col("max_repeats").cast("long")).alias("copies"))

    def report(self) -> DataFrame:
        """source_name, target_share, max_repeats, documents, used, tokens, actual_share, most_copies."""
        got = self.drawn().groupBy("source_name").agg(
            F.count(F.lit(1)).alias("documents"), F.count_if(F.col("copies") > 0).alias("used"), F.sum(F.col("copies") * F.col("tokens")).alias("tokens"), F.max("copies").alias("most_copies")
        )
        out = self.targets.join(got, "source_name", "left").fillna(0, ["documents", "used", "tokens", "most_copies"])
        whole = F.sum("tokens").over(W.partitionBy())
        return out.select("source_name", "target_share", "max_repeats", "documents", "used", "tokens", F.when(whole > 0, F.col("tokens") / whole).otherwise(0.0).alias("actual_share"), "most_copies")
