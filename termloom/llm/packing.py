"""Documents packed into containers of one fixed token capacity.

Vector best fit: a container has three capacities (tokens, documents, attention cost as the sum of squared lengths), an
item goes to the open container that admits it under all three and scores best, by the residual's norm or by the dot
product of demand and residual. Shards of bounded size are packed in parallel on sizes only; containers that a shard
leaves with room are opened again and their items packed across shards.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.session import cut_lineage

#: Items of one shard; a shard's packing takes items x open containers steps.
SHARD = 20_000
#: Packing goes on as long as a round leaves no more than this share of its items open.
PROGRESS = 0.5
_encoders: dict[str, object] = {}


@dataclass(frozen=True)
class Capacity:
    """Of one container. An attention capacity of tokens squared or more never binds, as the squares of lengths sum to no
    more than the square of their sum; the default admits half of that."""

    tokens: int = 2048
    documents: int = 256
    attention: float = 2048 * 2048 / 2


def token_counter(path: str, pattern: str):
    """Counts tokens by a public byte-pair vocabulary (ranks file) read from path, once per Python worker."""
    if path not in _encoders:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    encoder = _encoders[path]
    return lambda text: len(encoder.encode_ordinary(text)) if text else 0


def best_fit(sizes: np.ndarray, capacity: Capacity, rule: str = "residual_norm") -> np.ndarray:
    """Container number of each item; sizes must not exceed the token capacity.

    Items go in order of falling size. An item alone in a container is always admitted, so a size above the attention
    capacity's root gets one of its own. Ties go to the container opened first.
    """
    order = np.argsort(-sizes, kind="stable")
    limits = np.array([capacity.tokens, capacity.documents, capacity.attention], dtype=float)
    demand = np.stack((sizes / limits[0], np.full(len(sizes), 1 / limits[1]), sizes.astype(float) ** 2 / limits[2]), axis=1)
    weight = demand.mean(axis=0) if len(sizes) else np.ones(3)
    weight = weight / max(weight.sum(), 1e-12)
    room = np.empty((max(16, len(sizes)), 3))
    placed, used = np.empty(len(sizes), dtype=np.int64), 0
    slack = 1e-9
    for i in order:
        d = demand[i]
        free = room[:used]
        fits = np.flatnonzero((free >= d - slack).all(axis=1))
        if len(fits):
            left = free[fits]
            score = (((left - d) ** 2) * weight).sum(axis=1) if rule == "residual_norm" else -(left * d * weight).sum(axis=1)
            k = fits[int(score.argmin())]
            room[k] -= d
        else:
            k, used = used, used + 1
            room[k] = 1 - d
        placed[i] = k
    return placed


def document_sizes(docs: DataFrame, tokenizer: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, tokens; a null text has none."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = token_counter(tokenizer, pattern)
        for batch in batches:
            counted = pa.array([tokens(t.as_py()) for t in batch["text"]], pa.int64())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], counted], ["doc_id", "tokens"])

    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(count, "doc_id bigint, tokens bigint")


def _packer(turn: int, capacity: Capacity, rule: str, full: float):
    def one(shard: pa.Table) -> pa.Table:
        length = shard["token_end"].to_numpy() - shard["token_start"].to_numpy()
        placed = best_fit(length, capacity, rule)
        used = [(np.bincount(placed, w, 1), most) for w, most in ((length, capacity.tokens), (None, capacity.documents), (length.astype(float) ** 2, capacity.attention))]
        whole = np.any([u >= full * most for u, most in used], axis=0)[placed]
        number = (turn << 56) + shard["shard"].to_numpy() * (1 << 24) + placed
        return shard.append_column("container_id", pa.array(number, pa.int64())).append_column("whole", pa.array(whole))

    return one


def pack(sizes: DataFrame, capacity: Capacity = Capacity(), rule: str = "residual_norm", full: float = 0.98) -> DataFrame:
    """container_id, doc_id, piece, token_start, token_end for every row of sizes (doc_id, tokens).

    Only rows above the token capacity are cut, into pieces of exactly the capacity and a rest; no container exceeds any
    capacity, save that one item alone is always admitted. Rows without tokens (null included) are placed like any
    other, with token_end = token_start. Repeated rows are placed one by one. An empty table gives no rows.

    Items are packed in shards of about SHARD, each in a task of its own. Containers filled to less than full in all three
    capacities are opened again and their items packed anew across shards, until one shard holds all that is left, or a round
    leaves more than PROGRESS of its items open: then packing them once more would gain little.
    """
    if rule not in ("residual_norm", "dot_product"):
        raise ValueError(rule)
    size = F.coalesce("tokens", F.lit(0))
    cuts = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(size / capacity.tokens), F.lit(1)).cast("int") - 1), lambda i: i.cast("bigint") * capacity.tokens)
    pieces = sizes.select("doc_id", size.alias("tokens"), F.posexplode(cuts).alias("piece", "token_start")).withColumn(
        "token_end", F.least("tokens", F.col("token_start") + capacity.tokens)
    )
    items = cut_lineage(pieces.select("doc_id", "piece", "token_start", "token_end"))
    fixed, n, turn = [], items.count(), 0
    columns = ["container_id", "doc_id", "piece", "token_start", "token_end"]
    schema = "doc_id bigint, piece int, token_start bigint, token_end bigint, shard bigint, container_id bigint, whole boolean"
    while True:
        shards = max(1, -(-n // SHARD))
        # the number of partitions is given, so that small shards are not merged into one task
        sharded = items.withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards))).repartition(shards, "shard")
        packed = cut_lineage(sharded.groupBy("shard").applyInArrow(_packer(turn, capacity, rule, full), schema))
        left = packed.where("NOT whole").count()
        if shards == 1 or left > PROGRESS * n:
            fixed.append(packed.select(columns))
            break
        fixed.append(packed.where("whole").select(columns))
        if not left:
            break
        items, n, turn = packed.where("NOT whole").select("doc_id", "piece", "token_start", "token_end"), left, turn + 1
    out = fixed[0]
    for part in fixed[1:]:
        out = out.unionByName(part)
    return out


def violations(containers: DataFrame, sizes: DataFrame, capacity: Capacity = Capacity(), fill: float = 0.95) -> DataFrame:
    """check_name, violations of a packing against its sizes (doc_id, tokens): what would make it wrong, and whether there are
    more than 1 / fill of the least number of containers that all tokens and documents need (1 then)."""
    length = F.col("token_end") - F.col("token_start")
    per = containers.groupBy("container_id").agg(F.sum(length).alias("tokens"), F.count(F.lit(1)).alias("n"), F.sum(length.cast("double") * length).alias("attention"))
    placed = containers.groupBy("doc_id").agg(F.sum(length).alias("placed"), F.count(F.lit(1)).alias("pieces"), F.min("token_start").alias("first"), F.max("token_end").alias("last"))
    wanted = sizes.groupBy("doc_id").agg(F.sum(F.coalesce("tokens", F.lit(0))).alias("tokens"), F.count(F.lit(1)).alias("n"), F.max(F.coalesce("tokens", F.lit(0))).alias("most"))
    both = wanted.join(placed, wanted["doc_id"].eqNullSafe(placed["doc_id"]), "full")
    bad = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    of_docs = both.agg(
        bad(placed["pieces"].isNull()).alias("document_missing"), bad(wanted["n"].isNull()).alias("document_unknown"), bad(~F.col("placed").eqNullSafe(F.col("tokens"))).alias("tokens_lost"),
        bad((F.col("most") <= capacity.tokens) & (F.col("pieces") > F.col("n"))).alias("cut_without_need"),
    )
    of_containers = per.agg(
        bad(F.col("tokens") > capacity.tokens).alias("over_tokens"), bad(F.col("n") > capacity.documents).alias("over_documents"),
        bad((F.col("attention") > capacity.attention) & (F.col("n") > 1)).alias("over_attention"),
        F.when(F.count(F.lit(1)) * fill > F.greatest(*[F.ceil(F.coalesce(F.sum(c), F.lit(0)) / most) for c, most in (("tokens", capacity.tokens), ("n", capacity.documents))]) + 1, 1).otherwise(0).cast("bigint").alias("room_left"),
    )
    parts = []
    for row in (of_docs, of_containers):
        each = F.array(*[F.struct(F.lit(c).alias("check_name"), F.col(c).alias("violations")) for c in row.columns])
        parts.append(row.select(F.inline(each)))
    return parts[0].unionByName(parts[1])
