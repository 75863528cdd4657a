"""Byte-level BPE encoding and decoding with recursive DuckDB queries.

Each task splits its texts with the pre-tokenisation pattern and keeps the distinct pieces that it
has not met before. Their bytes become token-position rows, which a recursive query joins with the
merge table: in every round each piece contracts its leftmost pair of least rank, until no piece has
a pair left. Each piece's ids are decoded by an ordered aggregation over the vocabulary. Ids of pieces are
kept in a bounded two-generation cache of the Python worker, and their decoded bytes where they differ from
the piece's own; documents are put together from both.

A piece of over LONG_PIECE bytes is cut into chunks, which the same query encodes, and put together again
without loss: a sequence of tokens is the encoding of its bytes exactly if each two neighbours are that of
theirs (the first contraction across a border would occur in the border's two tokens alone as well). So where
two parts meet, the bytes of a few tokens on both sides are encoded anew; the result holds if its first token
is the one that stood there, and, going right, from the first token on that was there too. Time is in
proportion to a piece's length. Rounds run ROUNDS at a time, since a recursive query keeps the rows of all.

Defined results: a null or empty text has no ids; its digests are those of the empty string. Rows
are independent: repeated rows and ids give repeated results, and other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Generator, Iterator
from functools import lru_cache

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from echofold.llm.common import map_batches, normal_text

LONG_PIECE = 96
#: Bytes of a long piece's chunks, least bytes of a window on each side of a border, and of a block whose chunks are kept at once.
CHUNK, REACH, BLOCK = 32, 12, 1 << 20
ROUNDS = 24
#: Pieces encoded by one query, and pieces in a generation of the cache.
QUERY_BYTES = 200_000
CACHE_PIECES = 200_000
#: Characters that the pattern's \s stands for in the encoder this follows.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

CONTRACT_SQL = """
WITH RECURSIVE state(round, piece, pos, nxt, tok) AS (
    SELECT 0, piece, pos, nxt, tok FROM seed
    UNION ALL
    SELECT a.round + 1, a.piece, a.pos,
           CASE WHEN a.pos = k.at THEN k.after ELSE a.nxt END,
           CASE WHEN a.pos = k.at THEN k.merged ELSE a.tok END
    FROM state a
    JOIN (SELECT a.piece, min(m.merged) AS merged,
                 arg_min(a.pos, m.merged::BIGINT * 4294967296 + a.pos) AS at,
                 arg_min(b.pos, m.merged::BIGINT * 4294967296 + a.pos) AS gone,
                 arg_min(b.nxt, m.merged::BIGINT * 4294967296 + a.pos) AS after
          FROM state a
          JOIN state b ON b.piece = a.piece AND b.pos = a.nxt
          JOIN merges m ON m.l = a.tok AND m.r = b.tok
          GROUP BY a.piece) k ON k.piece = a.piece
    WHERE a.pos <> k.gone AND a.round < {rounds}
)
"""

#: What is left of the rounds: the rows of each piece's last one.
LAST = """
SELECT piece, pos, nxt, tok, round = {rounds} AS more
FROM state JOIN (SELECT piece AS p, max(round) AS last FROM state GROUP BY piece) ON piece = p AND round = last
"""

DECODE_SQL = """
SELECT piece, list(tok ORDER BY pos) AS ids, count(*) AS n, list(bytes ORDER BY pos) AS decoded
FROM done JOIN vocab USING (tok) GROUP BY piece ORDER BY piece
"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class PieceEncoder:
    """Encodes pieces by the rank file at path; one for each Python worker."""

    def __init__(self, path: str, pattern: str):
        self.ranks = ranks = read_ranks(path)
        self.split = regex.compile(pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"(?!\S)", f"(?![^{SPACE}])").replace(r"\s", f"[{SPACE}]")).findall
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs.append((left, right, rank))
        left, right, merged = (pa.array(column, pa.int32()) for column in zip(*pairs))
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "300MB", "preserve_insertion_order": False})
        merge_rows = pa.table({"l": left, "r": right, "merged": merged})
        vocab_rows = pa.table({"tok": pa.array(ranks.values(), pa.int32()), "bytes": pa.array(ranks.keys(), pa.binary())})
        for name, rows in (("merges", merge_rows), ("vocab", vocab_rows)):
            self.db.register("given", rows)
            self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
            self.db.unregister("given")
        #: int32 ids of pieces, and their decoded bytes where those aren't the piece's own.
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.otherwise: dict[str, bytes] = {}
        #: The same of pieces over LONG_PIECE bytes, for one batch of texts.
        self.long: dict[str, bytes] = {}
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.decimal = [str(i) for i in range(max(ranks.values()) + 1)]

    def _fixpoint(self, seed: pa.Table) -> list[pa.Table]:
        done = []
        query = CONTRACT_SQL.format(rounds=ROUNDS) + LAST.format(rounds=ROUNDS)
        while seed.num_rows:
            self.db.register("seed", seed)
            state = self.db.sql(query).to_arrow_table()
            self.db.unregister("seed")
            more = state.column("more")
            done.append(state.filter(pc.invert(more)).select(["piece", "pos", "tok"]))
            seed = state.filter(more).select(["piece", "pos", "nxt", "tok"])
        return done

    def _query(self, pieces: list[bytes]) -> list[tuple[bytes, bytes]]:
        """Ids and decoded bytes of pieces of at least one byte each."""
        lengths = np.array([len(p) for p in pieces])
        data = np.frombuffer(b"".join(pieces), np.uint8)
        piece = np.repeat(np.arange(len(pieces), dtype=np.int32), lengths)
        pos = (np.arange(len(data)) - np.repeat(np.cumsum(lengths) - lengths, lengths)).astype(np.int32)
        seed = pa.table({"piece": piece, "pos": pos, "nxt": pos + 1, "tok": self.single[data]})
        self.db.register("done", pa.concat_tables(self._fixpoint(seed)))
        found = self.db.sql(DECODE_SQL).to_arrow_table()
        self.db.unregister("done")
        count = found.column("n").to_numpy()
        ids = found.column("ids").combine_chunks().flatten().to_numpy().astype(np.int32).tobytes()
        tokens = found.column("decoded").combine_chunks().flatten().cast(pa.large_binary())
        _, starts, data = tokens.buffers()
        starts = np.frombuffer(starts, np.int64)[tokens.offset : tokens.offset + len(tokens) + 1]
        plain = data.to_pybytes()
        ends = np.cumsum(count)
        plain_ends = starts[ends]
        out, at, plain_at = [], 0, int(starts[0])
        for end, plain_end in zip((4 * ends).tolist(), plain_ends.tolist()):
            out.append((ids[at:end], plain[plain_at:plain_end]))
            at, plain_at = end, plain_end
        return out

    def _batched(self, pieces: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """_query over pieces of about QUERY_BYTES bytes at a time."""
        start, held = 0, 0
        for i, p in enumerate(pieces):
            held += len(p)
            if held > QUERY_BYTES or i + 1 == len(pieces):
                yield from self._query(pieces[start : i + 1])
                start, held = i + 1, 0

    def _know(self, wanted: list[bytes], known: dict[bytes, array]) -> None:
        fresh = list(dict.fromkeys(w for w in wanted if w not in known))
        for p, (ids, _) in zip(fresh, self._batched(fresh)):
            known[p] = array("i", ids)

    def _join(self, left: array, right: array, known: dict[bytes, array]) -> Generator[bytes, None, array]:
        """The encoding of the bytes of two encodings; yields windows that known lacks, to go on once it has them."""
        bytes_of, at = self.bytes_of, 0
        while at < len(right):
            start = held = len(left)
            size = 0
            while start and size < REACH:
                start -= 1
                size += len(bytes_of[left[start]])
            stop, size = at, 0
            while stop < len(right) and size < REACH:
                size += len(bytes_of[right[stop]])
                stop += 1
            while True:
                window = b"".join(map(bytes_of.__getitem__, left[start:])) + b"".join(map(bytes_of.__getitem__, right[at:stop]))
                if window not in known:
                    yield window
                found = known[window]
                if start == 0 or found[0] == left[start]:
                    break
                start = max(0, start - 2 * (held - start))
            del left[start:]
            left.extend(found)
            if found[-1] == right[stop - 1]:
                left.extend(right[stop:])
                return left
            at = stop
        return left

    def _joined(self, parts: list[array], known: dict[bytes, array]) -> array:
        """The encoding of all parts' bytes: neighbours two by two, all pairs of a level at once."""
        while len(parts) > 1:
            working = {i: self._join(parts[i], parts[i + 1], known) for i in range(0, len(parts) - 1, 2)}
            done = {len(parts) - 1: parts[-1]} if len(parts) % 2 else {}
            while working:
                wanted = []
                for i, join in list(working.items()):
                    try:
                        wanted.append(next(join))
                    except StopIteration as end:
                        done[i] = end.value
                        del working[i]
                self._know(wanted, known)
            parts = [done[i] for i in sorted(done)]
        return parts[0]

    def _encode_long(self, piece: bytes) -> array:
        whole = array("i")
        for at in range(0, len(piece), BLOCK):
            chunks = [piece[i : i + CHUNK] for i in range(at, min(at + BLOCK, len(piece)), CHUNK)]
            known: dict[bytes, array] = {}
            self._know(chunks, known)
            block = self._joined([known[c][:] for c in chunks], known)
            whole = self._joined([whole, block], known) if whole else block
        return whole

    def decoded(self, ids: array) -> bytes:
        """The bytes of ids, by ordered aggregations over the vocabulary, of a bounded number of ids each."""
        out = []
        for at in range(0, len(ids), QUERY_BYTES):
            part = np.array(ids[at : at + QUERY_BYTES], np.int32)
            self.db.register("done", pa.table({"pos": np.arange(len(part), dtype=np.int32), "tok": part}))
            out += self.db.sql("SELECT list(bytes ORDER BY pos) FROM done JOIN vocab USING (tok)").fetchall()[0][0]
            self.db.unregister("done")
        return b"".join(out)

    def learn(self, pieces: set[str]) -> None:
        """Makes the ids of all of pieces known to ids_of."""
        if len(self.young) > CACHE_PIECES:
            self.old, self.young = self.young, {}
        self.long.clear()
        young, old, fresh = self.young, self.old, []
        for p in pieces:
            if p not in young:
                if (known := old.get(p)) is not None:
                    young[p] = known
                else:
                    fresh.append(p)
        raw = [p.encode("utf-8", "surrogatepass") for p in fresh]
        for p, own in zip(fresh, raw):
            if len(own) > LONG_PIECE:
                ids = self._encode_long(own)
                self.long[p] = ids.tobytes()
                if (decoded := self.decoded(ids)) != own:
                    self.otherwise[p] = decoded
        short = [(p, own) for p, own in zip(fresh, raw) if len(own) <= LONG_PIECE]
        for (p, own), (ids, decoded) in zip(short, self._batched([own for _, own in short])):
            young[p] = ids
            if decoded != own:
                self.otherwise[p] = decoded

    def ids_of(self, pieces: list[str]) -> bytes:
        try:
            return b"".join([self.young[p] for p in pieces])
        except KeyError:
            return b"".join([self.long[p] if p in self.long else self.young[p] for p in pieces])


@lru_cache(maxsize=2)
def _encoder(path: str, pattern: str) -> PieceEncoder:
    return PieceEncoder(path, pattern)


def encode_texts(texts: list[str], path: str, pattern: str) -> Iterator[tuple[np.ndarray, str, bytes]]:
    """For each text its ids, the ids as decimal text, and the bytes that they decode to."""
    encoder = _encoder(path, pattern)
    split = [encoder.split(t) for t in texts]
    encoder.learn(set().union(*split))
    otherwise, decimal = encoder.otherwise, encoder.decimal
    for pieces in split:
        ids = np.frombuffer(encoder.ids_of(pieces), np.int32)
        if otherwise:
            decoded = b"".join([otherwise.get(p) or p.encode("utf-8", "surrogatepass") for p in pieces])
        else:
            decoded = "".join(pieces).encode("utf-8", "surrogatepass")
        yield ids, ",".join([decimal[i] for i in ids.tolist()]), decoded


def encode(docs: DataFrame, path: str, pattern: str, with_ids: bool = False, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """For each row: doc_id, n_tokens, ids_sha256, decoded_sha256; with_ids adds ids.

    path is where a rank file lies on every executor, pattern the pre-tokenisation pattern.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        n_tokens, ids_sha, decoded_sha, ids = [], [], [], []
        for found, text, decoded in encode_texts(batch.column("text").to_pylist(), path, pattern):
            n_tokens.append(len(found))
            ids_sha.append(hashlib.sha256(text.encode()).hexdigest())
            decoded_sha.append(hashlib.sha256(decoded).hexdigest())
            if with_ids:
                ids.append(found)
        out = {"doc_id": batch.column("doc_id"), "n_tokens": pa.array(n_tokens, pa.int64()), "ids_sha256": pa.array(ids_sha, pa.string()), "decoded_sha256": pa.array(decoded_sha, pa.string())}
        if with_ids:
            out["ids"] = pa.array(ids, pa.list_(pa.int32()))
        return pa.RecordBatch.from_pydict(out)

    given = docs.select(docs[id_column].alias("doc_id"), normal_text(docs[text_column]).alias("text"))
    kind = given.schema["doc_id"].dataType.simpleString()
    more = ", ids array<int>" if with_ids else ""
    return map_batches(given, work, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string{more}")


def decode(ids: list[int], path: str, pattern: str) -> bytes:
    """The bytes of ids, by an ordered aggregation over the vocabulary."""
    return _encoder(path, pattern).decoded(array("i", ids))
