"""Encoding of a corpus with a public byte-level BPE tokenizer, as recursive SQL.

Each partition runs DuckDB: the tokens of every word not met before are rows (word, position, token); a recursive query joins each
adjacent pair with the merge table and contracts, in every word at once, the pair of least rank from left to right, until no word
has a pair left; an ordered aggregation then puts each word's tokens together. Contracting all places of the pair in one step gives what contracting
the leftmost again and again gives, as a pair made by a merge always has a greater rank than the merge.

A long word has many different pairs, and its rounds would each go over all of it. It is cut into pieces of ``PIECE`` bytes, which are encoded
like words, and neighbours are joined two by two: the bytes of the last and first few tokens at a seam are encoded anew, and the result holds
if each token at the edge of that window and its neighbour outside give themselves when encoded together, otherwise the window is
doubled. (Tokens are the encoding of their text exactly if every two neighbours are the encoding of theirs.) Time grows with a word's length times the
logarithm of it, and no query ever sees more than ``QUERY_BYTES`` of words.

The work is a map over partitions: no shuffle but ``spread`` for small inputs. The merge table is read once on the driver and
broadcast after a check of its size; it belongs to the vocabulary and does not grow with the data. Words repeat, so a worker keeps
the words it has encoded, up to ``CACHED`` words, then starts anew.

Defined cases: null and empty texts give an empty list. Strings of special tokens in a text are ordinary text. Texts are encoded whole,
however long; lone surrogates, which UTF-8 cannot hold, are encoded as U+FFFD. Repeated rows give repeated rows.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakesift.runtime import spread

# Fixed value: how byte-level BPE of this vocabulary cuts a text into words.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY_LIMIT = 64 << 20
CACHED = 400_000
SLICE = 4_000_000
LONG, PIECE = 64, 16
QUERY_BYTES = 300_000

# Of hits that follow each other (a token repeated) the first is contracted, those from the third on in later rounds.
_MERGE = """
WITH RECURSIVE step(round, word, pos, token) AS (
  SELECT 0, word, pos, token FROM start
  UNION ALL
  (WITH pairs AS (
     SELECT round, word, pos, token, lead(token) OVER (PARTITION BY word ORDER BY pos) AS following FROM step),
   ranked AS (
     SELECT p.*, m.rank, m.merged, min(m.rank) OVER (PARTITION BY word) AS least
     FROM pairs p LEFT JOIN merges m ON p.token = m.first AND p.following = m.second),
   hits AS (SELECT *, coalesce(rank = least, false) AS hit FROM ranked WHERE least IS NOT NULL),
   placed AS (
     SELECT *, lag(hit, 1, false) OVER w AS before, lag(hit, 2, false) OVER w AS earlier FROM hits WINDOW w AS (PARTITION BY word ORDER BY pos))
   SELECT round + 1, word, pos, CASE WHEN hit AND NOT before THEN merged ELSE token END FROM placed WHERE NOT before OR earlier))
SELECT word, list(token ORDER BY pos) AS ids
FROM (SELECT *, max(round) OVER (PARTITION BY word) AS last FROM step) WHERE round = last GROUP BY word
"""


def default_path() -> str:
    """Where the vocabulary lies unless a path is given."""
    return os.path.join(os.environ.get("LAKESIFT_TOKENIZERS", "/opt/tokenizers"), "byte_bpe_50k.json")


def read_vocabulary(path: str) -> dict[str, list[int]]:
    """The merge table's columns and the token of each byte, from a tokenizer file."""
    if os.path.getsize(path) > VOCABULARY_LIMIT:
        raise ValueError(f"{path} is larger than {VOCABULARY_LIMIT} bytes, too large to broadcast")
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab = model["vocab"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    # Printable bytes stand for themselves, the others for the code points from 256 on, in order.
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    sign = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}
    return {
        "first": [vocab[a] for a, _ in pairs],
        "second": [vocab[b] for _, b in pairs],
        "rank": list(range(len(pairs))),
        "merged": [vocab[a + b] for a, b in pairs],
        "bytes": [vocab[sign[b]] for b in range(256)],
    }


class _Numbers(dict):
    """Words by number; words met for the first time get the next one and are listed in ``fresh``."""

    def __init__(self) -> None:
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        self.fresh.append(word)
        return n


class Encoder:
    """One DuckDB connection with the merge table, and the words encoded so far."""

    def __init__(self, vocabulary: dict[str, list[int]], cached: int = CACHED) -> None:
        import duckdb
        import regex

        self.words = regex.compile(WORDS)
        self.of_byte = np.array(vocabulary["bytes"], np.int32)
        self.cached = cached
        self.text_of = {t: bytes([b]) for b, t in enumerate(vocabulary["bytes"])}
        for first, second, merged in zip(vocabulary["first"], vocabulary["second"], vocabulary["merged"], strict=True):
            self.text_of[merged] = self.text_of[first] + self.text_of[second]
        self.con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "1GB", "temp_directory": ""})
        merges = pa.table({c: pa.array(vocabulary[c], pa.int32()) for c in ("first", "second", "rank", "merged")})
        self.con.register("_m", merges)
        self.con.execute("CREATE TABLE merges AS SELECT * FROM _m")
        self.con.unregister("_m")
        self._forget()

    def _forget(self) -> None:
        self.number = _Numbers()
        self.pieces: dict[bytes, list[int]] = {}
        self.flat, self.ends = np.zeros(1 << 16, np.int32), np.zeros(1 << 14, np.int64)  # the words' ids one after another, and where each word's end

    def encode(self, texts: list[str | None]) -> pa.Array:
        """The token ids of each text."""
        if len(self.number) + len(self.pieces) > self.cached:
            self._forget()
        word: list[int] = []
        bounds = [0]
        for t in texts:
            if t:
                try:
                    t.encode("utf-8")
                except UnicodeEncodeError:
                    t = t.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
                word.extend(map(self.number.__getitem__, self.words.findall(t)))
            bounds.append(len(word))
        if self.number.fresh:
            self._add(self.number.fresh)
            self.number.fresh = []
        w = np.array(word, np.int64)
        stop = self.ends[w]
        start = np.where(w > 0, self.ends[w - 1], 0)
        size = stop - start
        after = np.concatenate([[0], np.cumsum(size)])
        values = self.flat[np.arange(after[-1]) + np.repeat(start - after[:-1], size)]
        return pa.ListArray.from_arrays(pa.array(after[bounds], pa.int32()), pa.array(values, pa.int32()))

    def _add(self, fresh: list[str]) -> None:
        """Keep the ids of words met for the first time, in order."""
        texts = [w.encode("utf-8") for w in fresh]
        short, long = iter(self._merge([b for b in texts if len(b) <= LONG])), iter(self._long([b for b in texts if len(b) > LONG]))
        ids = [next(long if len(b) > LONG else short) for b in texts]
        base = len(self.number) - len(fresh)
        used = int(self.ends[base - 1]) if base else 0
        ends = used + np.cumsum([len(x) for x in ids])
        while len(self.flat) < ends[-1]:
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while len(self.ends) < len(self.number):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.flat[used : ends[-1]] = np.concatenate([np.asarray(x, np.int32) for x in ids])
        self.ends[base : len(self.number)] = ends

    def _merge(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of words by the recursive query."""
        out: list[np.ndarray] = []
        sizes = np.array([len(b) for b in words], np.int64)
        group = np.cumsum(sizes) // QUERY_BYTES if len(words) else sizes
        for g in np.unique(group):
            some = np.flatnonzero(group == g)
            n = sizes[some]
            starts = np.repeat(np.cumsum(n) - n, n)
            token = self.of_byte[np.frombuffer(b"".join(words[i] for i in some), np.uint8)]
            table = {"word": np.repeat(np.arange(len(some), dtype=np.int32), n), "pos": np.arange(len(token), dtype=np.int32) - starts.astype(np.int32), "token": token}
            self.con.register("start", pa.table(table))
            ids = self.con.sql(f"SELECT ids FROM ({_MERGE}) ORDER BY word").to_arrow_table().column("ids").combine_chunks()
            self.con.unregister("start")
            out += np.split(ids.flatten().to_numpy(), ids.offsets.to_numpy()[1:-1] - ids.offsets[0].as_py())
        return out

    def _encoded(self, texts: list[bytes]) -> list[list[int]]:
        """The ids of pieces of long words."""
        fresh = list(dict.fromkeys(t for t in texts if t not in self.pieces))
        self.pieces.update(zip(fresh, (x.tolist() for x in self._merge(fresh)), strict=True))
        return [self.pieces[t] for t in texts]

    def _stable(self, pairs: list[tuple[int, int] | None]) -> list[bool]:
        """Whether two neighbouring tokens give themselves when encoded together; true where there is no pair."""
        found = iter(self._encoded([self.text_of[a] + self.text_of[b] for a, b in filter(None, pairs)]))
        return [p is None or next(found) == list(p) for p in pairs]

    def _long(self, texts: list[bytes]) -> list[list[int]]:
        """The ids of long words: pieces joined two by two, in all words at once."""
        cuts = [range(0, len(t), PIECE) for t in texts]
        pieces = iter(self._encoded([t[i : i + PIECE] for t, c in zip(texts, cuts, strict=True) for i in c]))
        words = [[next(pieces) for _ in c] for c in cuts]
        while any(len(runs) > 1 for runs in words):
            # A seam is the word it is in and the number of its left run.
            seams = [(w, i) for w, runs in enumerate(words) for i in range(0, len(runs) - 1, 2)]
            joined: dict[tuple[int, int], list[int]] = {}
            k = 2
            while seams:
                sides = [(words[w][i], words[w][i + 1]) for w, i in seams]
                windows = self._encoded([b"".join(map(self.text_of.__getitem__, a[-k:] + b[:k])) for a, b in sides])
                edges = [(a[-k - 1], c[0]) if len(a) > k else None for (a, _), c in zip(sides, windows, strict=True)]
                edges += [(c[-1], b[k]) if len(b) > k else None for (_, b), c in zip(sides, windows, strict=True)]
                good = self._stable(edges)
                n = len(seams)
                for j, ((a, b), c) in enumerate(zip(sides, windows, strict=True)):
                    if good[j] and good[j + n]:
                        joined[seams[j]] = a[:-k] + c + b[k:]
                seams, k = [s for s in seams if s not in joined], 2 * k
            words = [[joined.get((w, i), runs[i]) for i in range(0, len(runs), 2)] for w, runs in enumerate(words)]
        return [runs[0] for runs in words]


_ENCODER: dict[str, Encoder] = {}


def encode_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id_col, ids array<int>): the token ids of every text."""
    spark = docs.sparkSession
    path = path or default_path()
    vocabulary = spark.sparkContext.broadcast(read_vocabulary(path))
    slim = spread(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _ENCODER:
            _ENCODER[path] = Encoder(vocabulary.value)
        encoder = _ENCODER[path]
        for batch in batches:
            texts = batch.column(1).to_pylist()
            start = 0
            while start < len(texts):
                end, size = start, 0
                while end < len(texts) and (end == start or size < SLICE):
                    size += len(texts[end] or "")
                    end += 1
                ids = encoder.encode(texts[start:end])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, end - start), ids], ["id", "ids"])
                start = end

    kind = slim.schema["id"].dataType.simpleString()
    return slim.mapInArrow(encode, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)
