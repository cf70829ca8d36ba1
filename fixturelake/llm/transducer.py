"""Corpus encoding with a public byte-level vocabulary through a minimal acyclic transducer.

The frequent words of the corpus are compiled, with their ids as output, into an automaton with shared
suffixes whose path weights number the words; its arrays lie in one folder and are mapped into memory by
every worker. Words outside it are merged exactly by the ranks of the vocabulary.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import os
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fixturelake.session import shared_dir

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how the vocabulary cuts text into words before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words compiled into the transducer, the most frequent first; the rest is merged word by word.
LEXICON_WORDS = 60_000
#: Words a worker remembers between batches.
REMEMBERED = 400_000


@lru_cache(maxsize=4)
def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@lru_cache(maxsize=1)
def cutter():
    return regex.compile(PATTERN)


def merge(word: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """Ids of one word: neighbouring parts of lowest rank merge first, leftmost among equals."""
    if (whole := ranks.get(word)) is not None:
        return (whole,)
    n = len(word)
    start, nxt, prev, end = list(range(n)), [*range(1, n), -1], [-1, *range(n - 1)], list(range(1, n + 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        r, i, e = heapq.heappop(heap)
        j = nxt[i] if alive[i] else -1
        if j < 0 or end[j] != e:
            continue
        end[i], alive[j], nxt[i] = end[j], False, nxt[j]
        if nxt[i] >= 0:
            prev[nxt[i]] = i
            if (r := ranks.get(word[start[i] : end[nxt[i]]])) is not None:
                heapq.heappush(heap, (r, i, end[nxt[i]]))
        if prev[i] >= 0 and (r := ranks.get(word[start[prev[i]] : end[i]])) is not None:
            heapq.heappush(heap, (r, prev[i], end[i]))
    return tuple(ranks[word[start[i] : end[i]]] for i in range(n) if alive[i])


def compile_lexicon(words: list[bytes], ranks: dict[bytes, int]) -> dict[str, np.ndarray]:
    """Arrays of the minimal acyclic transducer of the words, built from sorted words with a register of states."""
    words = sorted(set(words))
    register: dict[tuple, int] = {}
    edges: list[list[tuple[int, int]]] = []
    final: list[bool] = []
    count: list[int] = []

    def settle(node: dict) -> int:
        key = (node["final"], tuple(node["out"]))
        if (s := register.get(key)) is None:
            s = register[key] = len(edges)
            edges.append(list(node["out"]))
            final.append(node["final"])
            count.append(node["final"] + sum(count[t] for _, t in node["out"]))
        return s

    path = [{"final": False, "out": []}]
    labels: list[int] = []
    for w in words:
        k = 0
        while k < min(len(w), len(labels)) and w[k] == labels[k]:
            k += 1
        while len(labels) > k:
            s = settle(path.pop())
            path[-1]["out"].append((labels.pop(), s))
        for b in w[k:]:
            labels.append(b)
            path.append({"final": False, "out": []})
        path[-1]["final"] = True
    while labels:
        s = settle(path.pop())
        path[-1]["out"].append((labels.pop(), s))
    root = settle(path[0])
    keys, nxt, weight = [], [], []
    for s, out in enumerate(edges):
        before = int(final[s])
        for b, t in out:
            keys.append(s * 256 + b)
            nxt.append(t)
            weight.append(before)
            before += count[t]
    ids = [merge(w, ranks) for w in words]
    offsets = np.zeros(len(ids) + 1, np.int64)
    np.cumsum([len(i) for i in ids], out=offsets[1:]) if ids else None
    return {
        "keys": np.array(keys, np.int64), "next": np.array(nxt, np.int32), "weight": np.array(weight, np.int32),
        "final": np.array(final, np.bool_), "offsets": offsets, "ids": np.fromiter(chain.from_iterable(ids), np.int32), "root": np.array([root], np.int32),
    }


class Lexicon:
    """The transducer's arrays; find() walks many words at once, a byte of each per step."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.a = arrays

    def find(self, words: list[bytes]) -> list[tuple[int, ...] | None]:
        a, n = self.a, len(words)
        if not n or not len(a["keys"]):
            return [None] * n
        lengths = np.fromiter(map(len, words), np.int64, n)
        flat = np.frombuffer(b"".join(words), np.uint8)
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        state = np.full(n, a["root"][0], np.int64)
        number = np.zeros(n, np.int64)
        live = np.arange(n)
        for step in range(int(lengths.max(initial=0))):
            live = live[(lengths[live] > step) & (state[live] >= 0)]
            if not len(live):
                break
            key = state[live] * 256 + flat[starts[live] + step]
            at = np.minimum(np.searchsorted(a["keys"], key), len(a["keys"]) - 1)
            hit = a["keys"][at] == key
            number[live] += np.where(hit, a["weight"][at], 0)
            state[live] = np.where(hit, a["next"][at], -1)
        ok = (state >= 0) & (lengths > 0)
        ok &= a["final"][np.maximum(state, 0)]
        return [tuple(a["ids"][a["offsets"][k] : a["offsets"][k + 1]].tolist()) if o else None for o, k in zip(ok.tolist(), number.tolist())]


_LEXICA: dict[str, Lexicon] = {}


class SharedLexicon:
    """Where workers find the arrays: files to map into memory in the shared folder, or a broadcast of bounded size."""

    def __init__(self, spark: SparkSession, arrays: dict[str, np.ndarray]):
        self.name = hashlib.sha256(b"".join(v.tobytes() for v in arrays.values())).hexdigest()[:24]
        where = shared_dir(spark)
        self.folder, self.sent = None, None
        if where.startswith("file:") or where.startswith("/"):
            self.folder = os.path.join("/" + where.removeprefix("file:").lstrip("/"), f"lexicon-{self.name}")
            if not os.path.exists(self.folder):
                os.makedirs(tmp := f"{self.folder}.{os.getpid()}", exist_ok=True)
                for k, v in arrays.items():
                    np.save(f"{tmp}/{k}.npy", v)
                os.replace(tmp, self.folder) if not os.path.exists(self.folder) else None
        else:
            self.sent = spark.sparkContext.broadcast(arrays)

    def open(self) -> Lexicon:
        if self.name not in _LEXICA:
            _LEXICA.clear()
            names = ("keys", "next", "weight", "final", "offsets", "ids", "root")
            arrays = self.sent.value if self.sent is not None else {k: np.load(f"{self.folder}/{k}.npy", mmap_mode="r") for k in names}
            _LEXICA[self.name] = Lexicon(arrays)
        return _LEXICA[self.name]


class Encoder:
    """Encodes texts with a lexicon and the ranks; remembers words between calls."""

    def __init__(self, lexicon: Lexicon, ranks: dict[bytes, int]):
        self.lexicon, self.ranks, self.seen = lexicon, ranks, {}

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.seen]
        if len(self.seen) + len(new) > REMEMBERED:
            self.seen.clear()
            new = list(words)
        raw = [w.encode("utf-8", "surrogatepass") for w in new]
        for w, b, ids in zip(new, raw, self.lexicon.find(raw)):
            self.seen[w] = ids if ids is not None else merge(b, self.ranks)

    def encode(self, text: str) -> chain:
        words = cutter().findall(text)
        self.learn({w for w in words if w not in self.seen})
        return chain.from_iterable(map(self.seen.__getitem__, words))


def spread(df: DataFrame) -> DataFrame:
    """More, smaller tasks where few files hold the table: the work a row needs is far dearer than moving it."""
    want = df.sparkSession.sparkContext.defaultParallelism * 3
    return df.repartition(want) if df.rdd.getNumPartitions() < want else df


def frequent_words(texts: DataFrame, text: str, most: int = LEXICON_WORDS) -> list[bytes]:
    """The most frequent words over all texts, counted where they lie and summed in one aggregation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = cutter().findall
        counts: Counter = Counter()

        def out(c: Counter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([w.encode("utf-8", "surrogatepass") for w in c], pa.binary()), pa.array(list(c.values()), pa.int64())], names=["w", "n"])

        for b in batches:
            for t in b.column(0).to_pylist():
                if t:
                    counts.update(find(t))
            if len(counts) > 200_000:
                yield out(counts)
                counts = Counter()
        if counts:
            yield out(counts)

    counted = texts.select(text).mapInArrow(run, "w binary, n long").where(F.length("w") <= 64)
    top = counted.groupBy("w").agg(F.sum("n").alias("n")).where("n > 1").orderBy(F.desc("n"), "w").limit(most)
    return [bytes(r[0]) for r in top.select("w").collect()]


def encode_texts(df: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY, lexicon_words: int = LEXICON_WORDS) -> DataFrame:
    """(key, ids): token ids of every text, without special tokens.

    Null and empty texts have the empty list. Strings of special tokens in a text are ordinary text. Texts
    of any length are encoded whole. The lexicon comes from counts over all texts and changes speed only,
    never a result.
    """
    spark = df.sparkSession
    rows = spread(df.select(F.col(key), F.col(text).alias("_text")))
    shared = SharedLexicon(spark, compile_lexicon(frequent_words(rows, "_text", lexicon_words), ranks_of(vocabulary)))
    schema = T.StructType([df.schema[key], T.StructField("ids", T.ArrayType(T.IntegerType(), False), True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.open(), ranks_of(vocabulary))
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                values, offsets = array("i"), [0]
                for t in part.column(1).to_pylist():
                    if t:
                        values.extend(encoder.encode(t))
                    offsets.append(len(values))
                ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(values, np.int32) if len(values) else np.empty(0, np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=[key, "ids"])

    return rows.mapInArrow(run, schema)
