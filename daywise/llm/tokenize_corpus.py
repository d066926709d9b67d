"""Whole-corpus encoding with a public byte-level BPE by content-defined chunk reuse."""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from daywise.session import spread

#: The folder of the public vocabulary files, if no parameter names one.
TOKENIZERS = os.environ.get("DAYWISE_TOKENIZERS", "/opt/tokenizers")
#: Pre-tokens of the byte-level BPE (fixed value of the public tokenizer).
PRETOKEN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Chunk sizes in code points: no cut before LEAST, one at MOST at the latest, on average one in 2 ** MASK_BITS.
LEAST, MOST, MASK_BITS, REACH = 96, 2048, 8, 16
#: Where a pre-token ends whatever stands further to the left or right: before a first white space, and where one of
#: the classes letter, number and other turns into another; after an apostrophe a contraction may go on. The four
#: separators that libraries count as white space or not are no part of such a place.
SURE = r"""(?<=[^\s\x1c-\x1f])(?=[\s--[\x1c-\x1f]])|(?<=\p{L})(?=[^\p{L}\s\x1c-\x1f])|(?<=\p{N})(?=[^\p{N}\s\x1c-\x1f])|(?<=[^\p{L}\p{N}\s\x1c-\x1f'])(?=[\p{L}\p{N}])"""
#: Code points hashed at a time.
BLOCK = 1 << 20


@functools.lru_cache(maxsize=4)
def _encoder(folder: str, name: str):
    import tiktoken

    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding(name, pat_str=PRETOKEN, mergeable_ranks=ranks, special_tokens={})


@functools.lru_cache(maxsize=4)
def _packing(folder: str, name: str) -> str:
    """Ids of a vocabulary of at most 65,536 tokens take two bytes, of a larger one four."""
    return "<u2" if _encoder(folder, name).n_vocab <= 1 << 16 else "<u4"


@functools.lru_cache(maxsize=1)
def _sure():
    import regex

    return regex.compile(SURE, regex.V1), regex.compile(f"(?r){SURE}", regex.V1)


@functools.lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """The powers of the hash's base and of its inverse, modulo 2 ** 32, for the places of a block."""
    base = 0x9E3779B1
    with np.errstate(over="ignore"):
        up = np.cumprod(np.full(BLOCK + REACH, base, dtype=np.uint32), dtype=np.uint32)
        down = np.cumprod(np.full(BLOCK + REACH, pow(base, -1, 1 << 32), dtype=np.uint32), dtype=np.uint32)
    return up, down


def _proposed(points: np.ndarray) -> np.ndarray:
    """The ends of all windows of REACH code points whose hash has MASK_BITS leading zeros.

    The window's hash is a difference of running sums brought back to the window's own place, so it depends on the
    window's code points only.
    """
    up, down = _powers()
    out = []
    with np.errstate(over="ignore"):
        for a in range(0, max(1, len(points) - REACH + 1), BLOCK):
            part = points[a : a + BLOCK + REACH - 1]
            if len(part) < REACH:
                break
            sums = np.zeros(len(part) + 1, dtype=np.uint32)
            np.cumsum(part * up[: len(part)], out=sums[1:], dtype=np.uint32)
            rolled = (sums[REACH:] - sums[:-REACH]) * down[: len(part) - REACH + 1]
            rolled ^= rolled >> np.uint32(15)
            rolled *= np.uint32(0x2C1B3C6D)
            out.append(np.nonzero(rolled >> np.uint32(32 - MASK_BITS) == 0)[0] + (REACH + a))
    return np.concatenate(out) if out else np.zeros(0, dtype=np.int64)


def cuts_of(texts: list[str]) -> list[list[int]]:
    """The ends of the content-defined chunks of each text; the last is its length, and an empty text has none.

    A rolling hash over REACH code points proposes cuts, so equal passages are cut alike wherever they stand. The texts
    are hashed as one; windows that reach into a text's neighbour propose nothing.
    """
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    proposed = _proposed(points)
    own = np.searchsorted(starts, proposed, side="left") - 1  # an end belongs to the text it closes or lies in
    inside = proposed - starts[own] >= REACH if len(proposed) else np.zeros(0, dtype=bool)
    proposed, own = proposed[inside], own[inside]
    first = np.searchsorted(own, np.arange(len(texts) + 1))
    out = []
    for k, n in enumerate(sizes.tolist()):
        ends, last = [], 0
        if n > LEAST:
            for at in (proposed[first[k] : first[k + 1]] - starts[k]).tolist():
                while at - last > MOST:
                    last += MOST
                    ends.append(last)
                if at - last >= LEAST:
                    last = at
                    ends.append(at)
            while n - last > MOST:
                last += MOST
                ends.append(last)
        if n > last:
            ends.append(n)
        out.append(ends)
    return out


def split_at_sure_places(text: str, ends: list[int]) -> list[tuple[str, str]]:
    """``text`` as (seam, core) pairs in order, the last core empty.

    A core is what lies between the first and the last sure place of a chunk: its encoding is that of the same
    characters in the whole text. A seam is what is left between two cores; it begins and ends at sure places (or the
    text's ends), so encoding it by itself repairs the join exactly. Chunks without a sure place go into the seam.
    """
    ahead, back = _sure()
    out, held, last = [], 0, 0
    for end in ends:
        first = ahead.search(text, last + 1, end)
        if first is not None and (p := first.start()) < end:
            at = back.search(text, last + 1, end)
            q = at.start() if at is not None and last < at.start() < end else p
            if q > p:
                out.append((text[held:p], text[p:q]))
                held = q
        last = end
    out.append((text[held:], ""))
    return out


def _pack(ids: list[int], packing: str) -> bytes:
    return np.array(ids, dtype=packing).tobytes()


def encode_pieces(pieces: list[tuple[str, str]], folder: str, name: str) -> list[int]:
    """The ids of (seam, core) pairs: those of the joined text."""
    enc = _encoder(folder, name)
    return [i for seam, core in pieces for part in (seam, core) if part for i in enc.encode_ordinary(part)]


def _pieces(batches: Iterator[pd.DataFrame], folder: str, name: str) -> Iterator[pd.DataFrame]:
    """``doc_id, mark, seq, seam, core``: cores as text, seams as packed ids."""
    enc, packing = _encoder(folder, name), _packing(folder, name)
    for batch in batches:
        texts = [t or "" for t in batch["text"]]
        a = 0
        while a < len(texts):  # so many texts at a time as fill a block
            b, size = a, 0
            while b < len(texts) and (b == a or size + len(texts[b]) <= BLOCK):
                size += len(texts[b])
                b += 1
            which, seqs, seams, cores = [], [], [], []
            for i, ends in enumerate(cuts_of(texts[a:b]), a):
                for seq, (seam, core) in enumerate(split_at_sure_places(texts[i], ends)):
                    which.append(i)
                    seqs.append(seq)
                    seams.append(_pack(enc.encode_ordinary(seam), packing) if seam else b"")
                    cores.append(core)
            rows = batch[["doc_id", "mark"]].iloc[which].reset_index(drop=True)
            yield rows.assign(mark=rows["mark"].astype("Int64"), seq=pd.array(seqs, dtype="int32"), seam=seams, core=cores)
            a = b


def document_pieces(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """``doc_id, mark, seq, seam, core`` of all documents (see ``split_at_sure_places``); ``mark`` tells texts of one id apart."""
    docs = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("mark", F.xxhash64("text"))
    kind = docs.schema["doc_id"].dataType
    fields = [T.StructField("doc_id", kind), T.StructField("mark", T.LongType()), T.StructField("seq", T.IntegerType()), T.StructField("seam", T.BinaryType()), T.StructField("core", T.StringType())]
    return spread(docs).mapInPandas(lambda b: _pieces(b, folder, name), T.StructType(fields))


def encode_documents(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """``doc_id, ids``: the token ids of every document without special tokens.

    Documents are cut where their content says, and each chunk is its core between places where a pre-token surely
    ends. Cores are brought together and sorted, so each distinct one is encoded once where it arrives; the joins
    between cores are encoded with what stands on both sides of the cut, and the ids of a document put in order.
    Cores that many documents share are spread over several tasks (a rebalanced exchange may split them; a core's
    ids do not depend on where it is encoded). Null and empty texts give an empty list; repeated rows give one row,
    an id with several texts one row for each. ``reuse`` tells how often cores are shared.
    """
    pieces = document_pieces(documents, id_col=id_col, text_col=text_col, name=name, folder=folder)
    gathered = pieces.withColumn("h", F.xxhash64("core")).hint("rebalance", F.col("h")).sortWithinPartitions("h", "core")

    @F.pandas_udf(T.BinaryType())
    def encoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc, packing = _encoder(folder, name), _packing(folder, name)
        last, ids = "", b""  # equal cores stand together, also across batches
        for cores in batches:
            out = []
            for core in cores:
                if core != last:
                    last, ids = core, _pack(enc.encode_ordinary(core), packing)
                out.append(ids)
            yield pd.Series(out, dtype=object)

    both = gathered.select("doc_id", "mark", F.struct("seq", F.concat("seam", encoded("core")).alias("ids")).alias("piece"))
    # A document's pieces are its own ids, in order; nothing else is brought together.
    grouped = both.groupBy("doc_id", "mark").agg(F.sort_array(F.collect_set("piece")).alias("pieces"))

    @F.pandas_udf("array<int>")
    def joined(parts: pd.Series) -> pd.Series:
        packing = _packing(folder, name)
        return pd.Series([np.frombuffer(b"".join(row), dtype=packing).astype(np.int32) for row in parts])

    return grouped.select("doc_id", joined(F.transform("pieces", lambda p: p["ids"])).alias("ids"))


def reuse(documents: DataFrame, **options: str) -> DataFrame:
    """One row ``documents, cores, distinct_cores, core_chars, distinct_chars``: what encoding each core once saves."""
    pieces = document_pieces(documents, **options)
    per = pieces.groupBy(F.xxhash64("core").alias("h"), F.length("core").alias("size")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("seq") == 0).alias("docs"))
    held = F.col("size") > 0
    total = lambda c: F.coalesce(F.sum(F.when(held, c)), F.lit(0))
    return per.agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("documents"), total(F.col("n")).alias("cores"), F.count_if(held).alias("distinct_cores"), total(F.col("n") * F.col("size")).alias("core_chars"), total(F.col("size")).alias("distinct_chars"))


def token_counts(text: str = "text", *, name: str = "byte_bpe_50k", folder: str = TOKENIZERS):
    """A column with the number of ids of each whole text; 0 for null and empty texts."""

    @F.pandas_udf(T.LongType())
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = _encoder(folder, name)
        for batch in batches:
            codes, distinct = pd.factorize(batch)
            sizes = [len(x) for x in enc.encode_ordinary_batch(list(distinct), num_threads=1)]
            yield pd.Series([sizes[c] if c >= 0 else 0 for c in codes], dtype="int64")

    return counted(F.col(f"`{text}`"))
