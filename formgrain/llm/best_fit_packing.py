"""Best-fit packing with certified bounds.

Texts become token ids, cut into pieces of at most ``capacity`` (only longer ones are cut; the first piece takes the
remainder). Pieces are dealt at random into groups of about ``GROUP`` and each group is packed by best-fit decreasing. Dual
feasible functions give a lower bound on the sequences that the group needs: a group that meets it is certified, and only
its one slack sequence can still be improved by others. The emptiest sequences of the other groups are opened as well,
``RELEASE`` for each one above the bound, but at most half of a group's pieces; all opened sequences are dealt anew to fewer groups and
their documents packed again, until one group is left. Rounds are at most the logarithm of the groups. Pieces are dealt by
a number of their own, so repeated rows spread too, and no task ever holds more than about ``GROUP`` pieces.

Token ids equal those of the ``tokenizers`` file: the same ranks are run by tiktoken, which is four times as fast; texts
that hold the text of the special token, and those that tiktoken's pattern can't take (some hundred thousand blanks in a row), go
through ``tokenizers`` itself.

Defined cases: null and empty texts are one piece, the end id alone; repeated rows are packed twice; an empty table gives
no row; null ids are packed like others.
"""

from __future__ import annotations

import base64
import json
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formgrain.llm.common import materialise, prepare, table

CAPACITY = 2048
GROUP = 1 << 16
#: Sequences that a group opens again for each one above its bound.
RELEASE = 32

_ENCODERS: dict = {}


def vocabulary(name: str = "byte_bpe_50k") -> str:
    import public_tokenizers

    return public_tokenizers.path(f"{name}.json")


def encoder(path: str):
    """text -> uint32 ids, made once in each worker."""
    if path not in _ENCODERS:
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        exact = Tokenizer.from_file(path)
        special = [x["content"] for x in json.load(open(path))["added_tokens"]]
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path.replace(".json", ".tiktoken"), "rb"))}
        quick = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

        def encode(text: str) -> np.ndarray:
            if not any(x in text for x in special):
                try:
                    return quick.encode_to_numpy(text)
                except ValueError:  # the pattern's stack is limited
                    pass
            return np.array(exact.encode(text, add_special_tokens=False).ids, np.uint32)

        _ENCODERS[path] = encode
    return _ENCODERS[path]


def pieces(docs: DataFrame, id_col: str, text_col: str, capacity: int, path: str) -> DataFrame:
    kind = docs.schema[id_col].dataType.simpleString()
    cols = "doc_id", "piece", "start", "length", "ids_crc32"

    def run(batches):
        encode = encoder(path)
        for batch in batches:
            out = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.append(encode(text or ""), 0).astype("<u4")
                at, to = 0, (len(ids) - 1) % capacity + 1
                k = 0
                while at < len(ids):
                    out.append((key, k, at, to - at, zlib.crc32(ids[at:to].tobytes())))
                    at, to, k = to, to + capacity, k + 1
            types = batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)] if out else [pa.array([], t) for t in types], list(cols))

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-fit decreasing over sizes that are sorted from large to small: bin and offset of each.

    A set of bits says which amounts of room exist; its lowest bit from the size on is the tightest fit.
    """
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    have, n = 0, 0
    bins, offsets = [0] * len(sizes), [0] * len(sizes)
    for i, size in enumerate(sizes.tolist()):
        fit = have >> size
        if fit:
            room = size + (fit & -fit).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                have ^= 1 << room
        else:
            room, b, n = capacity, n, n + 1
        bins[i], offsets[i] = b, capacity - room
        left = room - size
        if left:
            if not rooms[left]:
                have |= 1 << left
            rooms[left].append(b)
    return np.array(bins, np.int64), np.array(offsets, np.int64)


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """The largest bound of a family of dual feasible functions.

    For a threshold t up to half the capacity, sizes above capacity - t count as a whole sequence, sizes from t count
    as they are, smaller ones as nothing; the functions that round down to multiples of capacity / (k + 1) are added.
    All are evaluated on the counts of sizes, of which there are at most ``capacity``.
    """
    counts = np.bincount(sizes, minlength=capacity + 1).astype(np.int64)
    values = np.arange(capacity + 1)
    mass = np.cumsum((counts * values)[::-1])[::-1]  # of sizes >= t
    number = np.cumsum(counts[::-1])[::-1]
    best = -(-int(mass[0]) // capacity)
    for t in range(1, capacity // 2 + 1):
        above = int(number[capacity - t + 1])
        best = max(best, -(-(above * capacity + int(mass[t]) - int(mass[capacity - t + 1])) // capacity))
    for k in range(1, 33):
        whole = (k + 1) * values % capacity == 0
        doubled = np.where(whole, k * values, (k + 1) * values // capacity * capacity)  # in units of k * capacity
        best = max(best, -(-int((counts * doubled).sum()) // (k * capacity)))
    return best


def pack_group(rows: pd.DataFrame, capacity: int, last: bool, step: int) -> pd.DataFrame:
    """One group: packed, its bound, and which of its sequences stay.

    A certified group lets go only its emptiest sequence, another one a fixed number for each sequence above the bound, with at most
    half of the pieces. From the second round on whole sequences come in: if packing anew takes more of them, they stay as they were.
    """
    rows = rows.sort_values(["length", "uid"], ascending=[False, True], kind="stable").reset_index(drop=True)
    sizes = rows["length"].to_numpy()
    bins, offsets = best_fit(sizes, capacity)
    if step and rows["sequence_id"].nunique() < bins.max() + 1:
        rows["done"], rows["gap"] = True, np.int64(rows["sequence_id"].nunique() - lower_bound(sizes, capacity))
        return rows
    filled = np.bincount(bins, weights=sizes).astype(np.int64)
    gap = len(filled) - lower_bound(sizes, capacity)
    stays = np.ones(len(filled), bool)
    if not last:
        emptiest = np.argsort(filled, kind="stable")[: 1 + RELEASE * gap]
        emptiest = emptiest[filled[emptiest] < capacity]
        stays[emptiest[np.cumsum(np.bincount(bins)[emptiest]) <= len(rows) // 2]] = False
    rows["sequence_id"] = (np.int64(step) << 58) + (rows["g"].to_numpy() << 24) + bins
    rows["offset"] = offsets
    rows["done"] = stays[bins]
    rows["gap"] = np.int64(gap)
    return rows


def _packer(capacity: int, last: bool, step: int, schema: str):
    names = [x.split()[0] for x in schema.split(", ")]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return pack_group(rows, capacity, last, step)[names]

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, path: str | None = None, group: int = GROUP) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and gap (its group's sequences
    above the certified bound; 0: proven optimal within the group)."""
    spark = docs.sparkSession
    prepare(spark)
    cut = pieces(docs, id_col, text_col, capacity, path or vocabulary())
    rest = materialise(cut.withColumn("uid", F.monotonically_increasing_id()), "pieces")
    kind = rest.schema["doc_id"].dataType.simpleString()
    names = "doc_id", "piece", "start", "length", "ids_crc32"
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, uid long, sequence_id long, offset long, g long, done boolean, gap long"
    rest = rest.withColumns({"sequence_id": F.lit(-1).cast("long"), "offset": F.lit(0).cast("long")})
    n = rest.count()
    groups, step, parts = max(-(-n // group), min(spark.sparkContext.defaultParallelism, n // 4096)), 0, []
    while n:
        last = groups <= 1
        dealt = rest.withColumn("g", F.pmod(F.xxhash64("sequence_id" if step else "uid", F.lit(step)), F.lit(max(1, groups))).cast("long"))
        packed = materialise(dealt.groupBy("g").applyInPandas(_packer(capacity, last, step, schema), schema), f"packed{step}")
        parts.append(packed.where("done").select(*names, "sequence_id", "offset", "gap"))
        if last:
            break
        rest = packed.where("not done").select(*names, "uid", "sequence_id", "offset")
        n = rest.count()
        groups, step = min(-(-n // group), groups - 1), step + 1
    if not parts:
        return rest.select(*names, "sequence_id", "offset", F.lit(0).cast("long").alias("gap"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


ORACLE: dict[str, str] = {}
