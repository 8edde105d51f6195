"""Byte-level BPE encoding and decoding with DuckDB recursive queries.

Each task holds one in-memory DuckDB. The words of a slice of
documents that are not cached yet become token-position rows, which join the
merge table; each word's leftmost pair of least rank is contracted, and the
recursion goes on until no pair of any word can merge. Decoding joins the
(position, id) rows of whole documents with the vocabulary and aggregates the
pieces in order of position.

A recursion of one merge a round would be quadratic in the length of a word, so
words are contracted in pieces of PIECE bytes, and borders are put right after:
a sequence of tokens is what contraction of the whole word gives exactly if
each two neighbours, contracted by themselves, give these two again (the first
merge across a border would be the first one across it in the two alone). Where
two neighbours do not, a window around them is contracted anew and its ends are
looked at in turn; windows double, at last they are the whole word.

Rank files are read on the driver (any readable path) and broadcast; their size
is checked, so what is broadcast does not grow with the data.
"""

from __future__ import annotations

import base64
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.storage import bounded_batches, lean

MAX_RANK_FILE_BYTES = 64 << 20
#: Text bytes that are turned into rows at a time, words (and pairs of tokens) that a task remembers, bytes in one recursive query.
SLICE_BYTES, CACHE_WORDS, QUERY_BYTES = 2 << 20, 500_000, 1 << 20
#: Bytes of a piece of a word; wider windows contract all occurrences of a pair in a round where that is provably the same.
PIECE, WIDE = 64, 512
#: Of a task's DuckDB. It may not spill: no local folder is written.
MEMORY = "400MB"

# State: one token list per word; every round lays the lists out as (word, position) rows.
_SHORT_SQL = """
WITH RECURSIVE state(w, t) USING KEY (w) AS (
  SELECT w, list(tok ORDER BY pos) FROM start_rows GROUP BY w
  UNION ALL
  SELECT s.w, s.t[:p - 1] || [m] || s.t[p + 2:]
  FROM state s JOIN (
    SELECT w, min(k) & 4294967295 AS p, (min(k) >> 32)::INT AS m
    FROM (SELECT w, (rank::BIGINT << 32) | pos AS k
          FROM (SELECT w, unnest(t[:-2]) AS a, unnest(t[2:]) AS b, unnest(range(1, len(t))) AS pos
                FROM state WHERE len(t) > 1) pairs
          JOIN merges ON pair = (a::BIGINT << 32) | b) ranked
    GROUP BY w) best ON best.w = s.w)
SELECT w, t FROM state
"""

# The same for wide windows. A merge is `simple` if no token made from its result has a smaller rank: contracting
# its other occurrences in the same round (left to right, without overlap) is then what the next rounds would do.
_LONG_SQL = """
WITH RECURSIVE state(w, t) USING KEY (w) AS (
  SELECT w, list(tok ORDER BY pos) FROM start_rows GROUP BY w
  UNION ALL
  SELECT w, list(CASE WHEN taken THEN rank ELSE a END ORDER BY pos) FILTER (WHERE NOT gone)
  FROM (
    SELECT *, coalesce(lag(taken) OVER (PARTITION BY w ORDER BY pos), false) AS gone
    FROM (
      SELECT *, hit AND (CASE WHEN simple THEN (pos - min(pos) OVER (PARTITION BY w, hit, run)) % 2 = 0
                              ELSE pos = min(pos) OVER (PARTITION BY w, hit) END) AS taken
      FROM (
        SELECT *, pos - row_number() OVER (PARTITION BY w, hit ORDER BY pos) AS run
        FROM (
          SELECT *, coalesce(rank = min(rank) OVER (PARTITION BY w), false) AS hit, min(rank) OVER (PARTITION BY w) AS least
          FROM (SELECT w, unnest(t) AS a, unnest(list_append(t[2:], NULL)) AS b, unnest(range(1, len(t) + 1)) AS pos
                FROM state WHERE len(t) > 1) pairs
          LEFT JOIN merges ON pair = (a::BIGINT << 32) | b)
        WHERE least IS NOT NULL)))
  GROUP BY w)
SELECT w, t FROM state
"""

_DECODE_SQL = "SELECT d, array_to_string(list(piece ORDER BY pos), '') AS s FROM id_rows JOIN vocab USING (id) GROUP BY d"


def read_ranks(path: str) -> bytes:
    """The bytes of a rank file, at most MAX_RANK_FILE_BYTES of them."""
    with open(path, "rb") as f:
        data = f.read(MAX_RANK_FILE_BYTES + 1)
    if len(data) > MAX_RANK_FILE_BYTES:
        raise ValueError(f"{path} is no rank file: over {MAX_RANK_FILE_BYTES} bytes")
    return data


class BpeEngine:
    """Encoder and decoder for one vocabulary: `ranks` is the content of a rank file, `pattern` splits text into words."""

    def __init__(self, ranks: bytes, pattern: str) -> None:
        import duckdb
        import regex

        self.find = regex.compile(pattern).findall
        self.rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line.strip())}
        rank, left, right, made, harder = self.rank, [], [], [], set()
        for token, r in rank.items():
            for k in range(1, len(token)):
                a, b = rank.get(token[:k]), rank.get(token[k:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    made.append(r)
                    harder.update(x for x in (a, b) if x > r)
        self.byte_id = np.array([rank[bytes([i])] for i in range(256)], dtype=np.int32)
        # A rank file's ranks are its token ids. Pieces are held as Latin-1 text, one character a byte.
        self.con = duckdb.connect(config={"threads": "1", "memory_limit": MEMORY, "temp_directory": ""})
        table = pa.table({"pair": (np.array(left, np.int64) << 32) | np.array(right, np.int64), "rank": np.array(made, np.int32), "simple": [m not in harder for m in made]})
        self.con.register("given", table)
        self.con.execute("CREATE TABLE merges AS SELECT * FROM given")
        self.con.unregister("given")
        self.con.register("given", pa.table({"id": pa.array(rank.values(), pa.int32()), "piece": [t.decode("latin-1") for t in rank]}))
        self.con.execute("CREATE TABLE vocab AS SELECT * FROM given")
        self.con.unregister("given")
        self.token = {r: t for t, r in rank.items()}
        self.cache: dict[str, bytes] = {}
        self.stable: dict[tuple[int, int], bool] = {}

    def _contract(self, words: list[bytes], sql: str) -> list[np.ndarray]:
        lens = np.array([len(w) for w in words])
        buf = np.frombuffer(b"".join(words), np.uint8)
        pos = np.arange(len(buf)) - np.repeat(np.cumsum(lens) - lens, lens)
        self.con.register("start_rows", pa.table({"w": np.repeat(np.arange(len(words), dtype=np.int32), lens), "pos": pos.astype(np.int32), "tok": self.byte_id[buf]}))
        out = self.con.sql(sql).to_arrow_table()
        self.con.unregister("start_rows")
        ids = out["t"].combine_chunks()
        flat, ends = ids.flatten().to_numpy(), np.concatenate([[0], np.cumsum(ids.value_lengths().to_numpy())])
        found: list[np.ndarray] = [None] * len(words)  # type: ignore[list-item]
        for k, w in enumerate(out["w"].to_pylist()):
            found[w] = flat[ends[k] : ends[k + 1]]
        return found

    def contracted(self, words: list[bytes]) -> list[np.ndarray]:
        """The tokens of each word, contracted as a whole."""
        found: list[np.ndarray] = [None] * len(words)  # type: ignore[list-item]
        for wide in (False, True):
            some = [k for k, w in enumerate(words) if (len(w) > WIDE) == wide]
            for a, b in slices([words[k] for k in some], QUERY_BYTES):
                for k, ids in zip(some[a:b], self._contract([words[k] for k in some[a:b]], _LONG_SQL if wide else _SHORT_SQL), strict=True):
                    found[k] = ids
        return found

    def in_pieces(self, words: list[bytes]) -> list[np.ndarray]:
        """The tokens of each word, from its pieces; most words are one."""
        cut = [range(0, len(w), PIECE) for w in words]
        pieces = iter(self.contracted([w[k : k + PIECE] for w, at in zip(words, cut, strict=True) for k in at]))
        done: list[np.ndarray] = []
        open_: dict[int, tuple[list[int], list[int]]] = {}  # of words of several pieces: tokens, and the places of doubtful borders
        for w, at in enumerate(cut):
            parts = [next(pieces) for _ in at]
            done.append(parts[0])
            if len(parts) > 1:
                open_[w] = np.concatenate(parts).tolist(), np.cumsum([len(p) for p in parts[:-1]]).tolist()
        width = 2
        while open_:
            self._judge({(ids[k - 1], ids[k]) for ids, doubtful in open_.values() for k in doubtful})
            windows = []
            for w, (ids, doubtful) in list(open_.items()):
                wrong = [k for k in doubtful if not self.stable[ids[k - 1], ids[k]]]
                if not wrong:
                    done[w] = np.array(ids, np.int32)
                    del open_[w]
                    continue
                end = 0
                for k in wrong:  # windows do not overlap; what they leave out comes in the next turn
                    if k - 1 >= end:
                        low, end = max(end, k - width), min(len(ids), k + width)
                        windows.append((w, low, end))
                open_[w] = ids, wrong
            news = self.contracted([b"".join(self.token[x] for x in open_[w][0][a:b]) for w, a, b in windows])
            made: dict[int, list[tuple[int, int, list[int]]]] = {}
            for (w, a, b), new in zip(windows, news, strict=True):
                made.setdefault(w, []).append((a, b, new.tolist()))
            for w, parts in made.items():
                ids, wrong = open_[w]
                out: list[int] = []
                edges: set[int] = set()
                last = 0
                left = iter([*wrong, len(ids) + 1])
                k = next(left)
                for a, b, new in [*parts, (len(ids), len(ids), [])]:
                    while k < a:  # doubtful borders outside of windows
                        if k > last:
                            edges.add(len(out) + k - last)
                        k = next(left)
                    out += ids[last:a]
                    edges.add(len(out))
                    out += new
                    edges.add(len(out))
                    while k < b:
                        k = next(left)
                    last = b
                open_[w] = out, sorted(e for e in edges if 0 < e < len(out))
            width *= 2
        return done

    def _judge(self, pairs: set[tuple[int, int]]) -> None:
        """Remember of each pair of tokens whether it stays as it is."""
        if len(self.stable) + len(pairs) > CACHE_WORDS:
            self.stable.clear()
        new = [p for p in pairs if p not in self.stable]
        for p, ids in zip(new, self.contracted([self.token[a] + self.token[b] for a, b in new]), strict=True):
            self.stable[p] = ids.tolist() == list(p)

    def learn(self, words: set[str]) -> None:
        """Encode the words that are not cached."""
        new = [w for w in words if w not in self.cache]
        if len(self.cache) + len(new) > CACHE_WORDS:
            self.cache.clear()
            new = list(words)
        rest = []
        for w in new:
            b = w.encode("utf-8", "replace")
            if (i := self.rank.get(b)) is not None:
                self.cache[w] = np.int32(i).tobytes()
            else:
                rest.append((w, b))
        for (w, _), ids in zip(rest, self.in_pieces([b for _, b in rest]), strict=True):
            self.cache[w] = ids.tobytes()

    def close(self) -> None:
        """Give back all that is held; workers outlive tasks."""
        self.con.close()
        self.cache, self.rank, self.token, self.stable = {}, {}, {}, {}
        gc.collect()
        pa.default_memory_pool().release_unused()

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        words = [self.find(t) if t else [] for t in texts]
        self.learn(set().union(*words))
        get = self.cache.__getitem__
        return [np.frombuffer(b"".join(map(get, x)), np.int32) for x in words]

    def decode(self, ids: list[np.ndarray]) -> list[bytes]:
        lens = np.array([len(x) for x in ids])
        flat = np.concatenate([np.zeros(0, np.int32), *ids])
        self.con.register("id_rows", pa.table({"d": np.repeat(np.arange(len(ids), dtype=np.int32), lens), "pos": np.arange(len(flat), dtype=np.int32), "id": flat.astype(np.int32)}))
        out = self.con.sql(_DECODE_SQL).to_arrow_table()
        self.con.unregister("id_rows")
        text = dict(zip(out["d"].to_pylist(), out["s"].to_pylist(), strict=True))
        return [text.get(k, "").encode("latin-1") for k in range(len(ids))]


def slices(texts: list, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about `limit` characters or bytes each, one at least."""
    start = held = 0
    for k, t in enumerate(texts):
        held += len(t or "")
        if held >= limit:
            yield start, k + 1
            start, held = k + 1, 0
    if start < len(texts):
        yield start, len(texts)


def encode_decode(df: DataFrame, rank_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """(id, ids array<int>, decoded binary) of every row of `df`; rows map one to one, no shuffle.

    A null text counts as empty: no ids, no bytes. Strings that other encoders
    treat as special tokens are ordinary text. Repeated rows give repeated
    results; other columns of `df` are ignored; an empty table gives an empty one.
    Smaller slices take less memory and some more time; results are the same.
    """
    bounded_batches(df.sparkSession)
    ranks = df.sparkSession.sparkContext.broadcast(read_ranks(rank_path))
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine = BpeEngine(ranks.value, pattern)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices(texts, slice_bytes):
                ids = engine.encode(texts[a:b])
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                listed = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int32), *ids])))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), listed, pa.array(engine.decode(ids), pa.binary())], names=[id_col, "ids", "decoded"])
        engine.close()

    return df.select(id_col, F.col(text_col).cast("string").alias("_text")).mapInArrow(lean(run), f"`{id_col}` {id_type}, ids array<int>, decoded binary")


def digests(coded: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of what :func:`encode_decode` returns."""
    return coded.select(
        id_col,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
