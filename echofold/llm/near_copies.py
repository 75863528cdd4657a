"""Near copies by the Jaccard coefficient of word shingles, exact at any threshold.

A text is the set of the hashes of its shingles; two are near copies if the coefficient reaches least. Pairs come
first from the SimHash of the same hashes, by op5's index of positional bytes, its tallies and its verification
(simhash.links), and are checked by their coefficient. A SimHash can't promise all: at a coefficient of 0.8 two
fingerprints are expected to differ in 15 % of their bits, more than one a byte, so no count of shared positional
bytes is guaranteed at any width. What it leaves is found by an exact prefix join.

Equal sets are one node. In any one order of tokens, two sets of coefficient t or more share one of the
first n - ceil(t n) + 1 tokens of each; here tokens that are frequent in a sample of texts come last. The
sample decides on the length of the lists only, never on the result. Tokens are hashes of 48 bits.

Entries (token, set) are dealt to parts of about PART_ENTRIES by a hash of the token, packed by set, so that a list
of sets lies in one part; tokens frequent in the sample are dealt by the set as well. Lists of the same members
in one part count once, with their number. For the pairs of lists of up to LIST_MOST the shared tokens are
tallied: the first tokens that two sets share lie in the prefixes of both, all but as many as the coefficient
allows to be missing, so a pair needs a guaranteed minimum (longer lists count as shared for both). What reaches it
is verified: first, with the pairs of the SimHash, each set that has none with the least of its partners and the members of
a longer list with the one that has most tokens in such lists, the hub; then pairs of what isn't connected by that, and of
all longer lists of one hub the members outside the largest component with all of another component, unless their distances
to the hub differ by more than 1 - least (Jaccard distance is a metric) or the tokens that they share in long lists, tallied
within a task, are too few. No link between components is lost. Only groups of texts that are nearly alike enough cost more
than in proportion to their number.

Pairs are verified in groups of up to CHUNK_PAIRS with one set; the texts that occur in pairs are read again.

Defined results: of fewer words than a shingle, the whole sequence is one; texts without words are alike.
"""

from __future__ import annotations

from itertools import combinations
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echofold.llm import simhash
from echofold.llm.common import give_back, join_by_key, map_batches, normal_text, split_by
from echofold.llm.simhash import BITS, SEED, folded, labelled, representatives, shingle_hashes
from echofold.operators.components import connected_components
from echofold.operators.similarity import BOUND_SLACK, within_size_window
from echofold.plans.staging import discard, settle, staged

SHINGLE, LEAST = 5, 0.8
LIST_MOST = 4
#: Entries of a part, and pairs of a group with one set.
PART_ENTRIES, CHUNK_PAIRS = 500_000, 1024
#: Members of a block of those that share a hub.
HUB_BLOCK = 1024
#: Sets of which a task remembers that it has dealt them.
SEEN_SETS = 200_000
TOKEN_BYTES = 6
#: About so many texts tell which tokens are frequent; those of FREQUENT texts or more do, COMMON_MOST at most.
SAMPLE_TEXTS, FREQUENT, COMMON_MOST = 10_000, 3, 100_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def distinct_tokens(hashes: np.ndarray) -> np.ndarray:
    return np.unique((hashes >> np.uint64(16)).view(np.int64))


def tokens_of(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of a UTF-8 text's shingles, sorted, of 48 bits."""
    return distinct_tokens(shingle_hashes(text, shingle))


def packed(tokens: np.ndarray) -> bytes:
    return np.ascontiguousarray(tokens).view(np.uint8).reshape(-1, 8)[:, :TOKEN_BYTES].tobytes()


def unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // TOKEN_BYTES, 8), np.uint8)
    out[:, :TOKEN_BYTES] = np.frombuffer(data, np.uint8).reshape(-1, TOKEN_BYTES)
    return out.view(np.int64).ravel()


def prefix(tokens: np.ndarray, least: float, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The tokens of which any set alike shares one; common (sorted) come last, by counts."""
    n = len(tokens)
    most = n - ceil(n * least - BOUND_SLACK) + 1 if n else 0
    place = np.zeros(n, np.int64)
    if len(common) and n:
        at = np.minimum(np.searchsorted(common, tokens), len(common) - 1)
        place = np.where(common[at] == tokens, counts[at], 0)
    return tokens[np.lexsort((tokens, place))[:most]]


def _set_id(tokens: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(tokens.tobytes(), SEED)).astype(np.int64))


def common_tokens(docs: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens that are frequent in a sample of different texts, sorted, and their counts."""
    rate = min(1.0, SAMPLE_TEXTS / max(1, docs.count()))
    some = docs.select(normal_text(docs["text"]).alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(1 << 40)) < F.lit(int(rate * (1 << 40)))).distinct()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [tokens_of(t, shingle) for t in batch.column("text").cast(pa.binary()).to_pylist()]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(found), pa.int64())], ["token"])

    counted = map_batches(some, work, "token long").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    rows = counted.where(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "token").limit(COMMON_MOST).toArrow().sort_by("token")
    return rows.column("token").to_numpy(), rows.column("n").to_numpy()


def described(docs: DataFrame, shingle: int, least: float, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(doc_id, tie, fp, sim, n, prefix) for each row; tie is a hash of the text, sim its SimHash, prefix the tokens' bytes."""
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes = [shingle_hashes(t, shingle) for t in batch.column("text").cast(pa.binary()).to_pylist()]
        found = [distinct_tokens(h) for h in hashes]
        sims = np.array([folded(h) for h in hashes], np.uint64).view(np.int64)
        columns = [batch.column("doc_id"), batch.column("tie"), pa.array([_set_id(t) for t in found], pa.int64()), pa.array(sims)]
        columns += [pa.array([len(t) for t in found], pa.int32()), pa.array([packed(prefix(t, least, *shared.value)) for t in found], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "tie", "fp", "sim", "n", "prefix"])

    given = docs.select(docs["doc_id"].alias("doc_id"), normal_text(docs["text"]).alias("text")).withColumn("tie", F.xxhash64("text"))
    kind = given.schema["doc_id"].dataType.simpleString()
    return map_batches(given, work, f"doc_id {kind}, tie long, fp long, sim long, n int, prefix binary")


def _mixed(values: np.ndarray) -> np.ndarray:
    """Spread bits of longs, as unsigned longs."""
    found = (values.view(np.uint64) ^ (values.view(np.uint64) >> np.uint64(31))) * _MIX
    return found ^ (found >> np.uint64(29))


DEALT = "part int, hot boolean, fps binary, ns binary, counts binary, tokens binary, places binary"


def _dealt(found: DataFrame, parts: int, common: np.ndarray) -> DataFrame:
    """Entries of found (fp, n, prefix), packed by part; hot ones are those of common tokens.

    A task deals a set once, as a partial aggregate would, however many rows have it.
    """
    shared = found.sparkSession.sparkContext.broadcast(common)

    def deal(batches):
        common, young, old = shared.value, set(), set()
        for batch in batches:
            fresh = []
            for i, fp in enumerate(batch.column("fp").to_pylist()):
                if fp not in young and fp not in old:
                    fresh.append(i)
                young.add(fp)
            if len(young) > SEEN_SETS:
                young, old = set(), young
            batch = batch.take(pa.array(fresh, pa.int32()))
            prefixes = batch.column("prefix").to_pylist()
            lengths = np.array([len(p) // TOKEN_BYTES for p in prefixes], np.int64)
            tokens = unpacked(b"".join(prefixes))
            if not len(tokens):
                continue
            fps, ns, row = batch.column("fp").to_numpy(), batch.column("n").to_numpy(), np.repeat(np.arange(len(lengths)), lengths)
            hot = np.zeros(len(tokens), np.bool_)
            if len(common):
                hot = common[np.minimum(np.searchsorted(common, tokens), len(common) - 1)] == tokens
            part = (_mixed(tokens ^ np.where(hot, fps[row], 0)) % np.uint64(parts)).astype(np.int64)
            kind = 2 * part + hot
            at = (np.arange(len(tokens)) - np.repeat(np.cumsum(lengths) - lengths, lengths)) * 256 // lengths[row]
            order = np.argsort(kind, kind="stable")
            out = []
            for group in np.split(order, np.flatnonzero(np.diff(kind[order])) + 1):
                rows, counts = np.unique(row[group], return_counts=True)
                one = kind[group[0]]
                out.append((one >> 1, bool(one & 1), fps[rows].tobytes(), ns[rows].astype(np.int32).tobytes(), counts.astype(np.int32).tobytes(), packed(tokens[group]), at[group].astype(np.uint8).tobytes()))
            columns = zip(zip(*out), (pa.int32(), pa.bool_(), *[pa.binary()] * 5))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], ["part", "hot", "fps", "ns", "counts", "tokens", "places"])

    return found.select("fp", "n", "prefix").mapInArrow(deal, DEALT)


CANDIDATES = "a long, b long, an int, bn int, token long, weight int, place int"


def _met(least: float, list_most: int):
    """For the entries of a part: pairs (a, b, weight) of its short lists, and members (a, token, weight) of its long ones."""
    close = lambda x, y: np.maximum(x, y) <= np.floor(np.minimum(x, y) / least + BOUND_SLACK)

    def meet(part: pa.Table) -> pa.Table:
        column = lambda name: b"".join(part.column(name).to_pylist())
        counts = np.frombuffer(column("counts"), np.int32)
        fps, ns = (np.repeat(np.frombuffer(column(name), kind), counts) for name, kind in (("fps", np.int64), ("ns", np.int32)))
        tokens, places = unpacked(column("tokens")), np.frombuffer(column("places"), np.uint8)
        hot = np.repeat(part.column("hot").to_numpy(zero_copy_only=False).astype(np.bool_), [len(t) // TOKEN_BYTES for t in part.column("tokens").to_pylist()])
        order = np.lexsort((fps, tokens))
        tokens, fps, ns, hot, places = tokens[order], fps[order], ns[order], hot[order], places[order]
        once = np.concatenate(([True], (tokens[1:] != tokens[:-1]) | (fps[1:] != fps[:-1])))[: len(tokens)]
        tokens, fps, ns, hot, places = tokens[once], fps[once], ns[once], hot[once], places[once]
        starts = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1]))[: len(tokens)])
        lengths = np.diff(np.append(starts, len(tokens)))
        # One list of each kind: the same members, or a common token.
        digest = np.add.reduceat(_mixed(fps), starts) if len(starts) else np.zeros(0, np.uint64)
        digest = np.where(hot[starts], tokens[starts].view(np.uint64), digest)
        several = np.flatnonzero((lengths > 1) | hot[starts])
        kinds = np.stack([digest[several], 2 * lengths[several].astype(np.uint64) + hot[starts[several]]])
        _, first, weight = np.unique(kinds, axis=1, return_index=True, return_counts=True) if len(several) else (None, several, several)
        starts, lengths = starts[several[first]], lengths[several[first]]
        long = (lengths > list_most) | hot[starts]
        pairs = [np.zeros((5, 0), np.int64)]
        for m in np.unique(lengths[~long]).tolist():
            at, times = starts[(lengths == m) & ~long], weight[(lengths == m) & ~long]
            for i, j in combinations(range(m), 2):
                near = close(ns[at + i], ns[at + j])
                x, y = at[near] + i, at[near] + j
                pairs.append(np.stack([fps[x], fps[y], ns[x], ns[y], times[near]]))
        found = pd.DataFrame(np.concatenate(pairs, axis=1).T, columns=["a", "b", "an", "bn", "weight"])
        found = found.groupby(["a", "b"], as_index=False, sort=False).agg({"an": "first", "bn": "first", "weight": "sum"})
        short = pa.table({**{c: pa.array(found[c].to_numpy(), t) for c, t in (("a", pa.int64()), ("b", pa.int64()), ("an", pa.int32()), ("bn", pa.int32()))}, "token": pa.nulls(len(found), pa.int64()), "weight": pa.array(found["weight"].to_numpy(), pa.int32()), "place": pa.nulls(len(found), pa.int32())})
        rows = np.concatenate([np.arange(s, s + n) for s, n in zip(starts[long], lengths[long])]) if long.any() else np.zeros(0, np.int64)
        members = {"a": fps[rows], "b": pa.nulls(len(rows), pa.int64()), "an": pa.array(ns[rows], pa.int32()), "bn": pa.nulls(len(rows), pa.int32()), "token": tokens[rows], "weight": pa.array(np.repeat(weight[long], lengths[long]), pa.int32()), "place": pa.array(places[rows], pa.int32())}
        give_back()
        return pa.concat_tables([short, pa.table(members)])

    return meet


def least_shared(an: Column, bn: Column, least: float) -> Column:
    """How many tokens the prefixes of two sets share at least if their coefficient reaches least."""
    common = F.ceil((an + bn) * F.lit(least / (1 + least)) - F.lit(BOUND_SLACK))
    return F.greatest(common - F.ceil(F.greatest(an, bn) * F.lit(least) - F.lit(BOUND_SLACK)) + 1, F.lit(1))


def _scored(pairs: DataFrame, docs: DataFrame, named: DataFrame, shingle: int) -> DataFrame:
    """pairs (a, b) with score, the coefficient of their sets; named has a row (doc_id, tie) for each fp."""
    sizes = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("held")).withColumn("chunks", F.ceil(F.col("held") / CHUNK_PAIRS).cast("int"))
    sizes = staged(sizes, "pair-hubs")
    others = join_by_key(pairs, sizes, "a", "held", pairs.count()).select("a", F.pmod(F.xxhash64("b"), F.col("chunks")).cast("int").alias("chunk"), F.col("b").alias("fp"))
    hubs = sizes.select("a", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.col("a").alias("fp"))
    asks = others.unionByName(hubs).groupBy("fp").agg(F.collect_list(F.struct("a", "chunk")).alias("asks"))
    asks = staged(asks.join(named, "fp").select(F.coalesce("doc_id", F.lit("")).alias("id_"), "tie", "asks"), "asks")
    given = docs.select(F.coalesce(docs["doc_id"].cast("string"), F.lit("")).alias("id_"), normal_text(docs["text"]).alias("text")).withColumn("tie", F.xxhash64("text"))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [tokens_of(t, shingle) for t in batch.column("text").cast(pa.binary()).to_pylist()]
        return pa.RecordBatch.from_arrays([pa.array([_set_id(t) for t in found], pa.int64()), pa.array([packed(t) for t in found], pa.binary()), batch.column("asks")], ["fp", "tokens", "asks"])

    near, _ = split_by(given, asks, "id_", "tie")
    sets = map_batches(near.join(asks, ["id_", "tie"]).select("text", "asks"), work, "fp long, tokens binary, asks array<struct<a:long,chunk:int>>")

    def compare(group: pa.Table) -> pa.Table:
        members = {fp: i for i, fp in enumerate(group.column("fp").to_pylist())}
        tokens, hub = group.column("tokens"), group.column("a")[0].as_py()
        own = unpacked(tokens[members[hub]].as_py())
        out = []
        for fp, i in members.items():
            if fp != hub:
                other = unpacked(tokens[i].as_py())
                common = len(np.intersect1d(own, other, assume_unique=True))
                out.append((hub, fp, common / max(1, len(own) + len(other) - common)))
        a, b, score = zip(*out) if out else ((), (), ())
        if len(out) > 100:
            give_back()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "score": pa.array(score, pa.float64())})

    each = sets.select("fp", "tokens", F.explode("asks").alias("ask")).select("ask.a", "ask.chunk", "fp", "tokens")
    return each.groupBy("a", "chunk").applyInArrow(compare, "a long, b long, score double")


def _shared(least: float):
    """For members of hubs, in blocks: pairs (a, b) of which the tokens that they share in long lists are enough.

    Of a pair that shares no token in a short list these are all that their prefixes share. What comes before one of them
    and isn't shared is lost, so sets share at most these and what follows it in both.
    """

    def tally(dealt: pa.Table) -> pa.Table:
        rows = dealt.select(["hub", "i", "j", "fp", "n", "part", "away", "as_x", "as_y"]).to_pandas()
        own = dealt.column("own").combine_chunks()
        held = np.diff(own.offsets.to_numpy())
        tokens, weights, places = (own.flatten().field(k).to_numpy() for k in ("token", "weight", "place"))
        first = np.cumsum(held) - held
        ns = rows["n"].to_numpy(np.int64)
        prefixes = ns - np.ceil(ns * least - BOUND_SLACK).astype(np.int64) + 1
        after = np.repeat(ns, held) - 1 - -(-places.astype(np.int64) * np.repeat(prefixes, held) // 256)
        fps, parts, away = rows["fp"].to_numpy(), rows["part"].to_numpy(), rows["away"].to_numpy(np.float64)
        as_x, as_y = rows["as_x"].to_numpy(), rows["as_y"].to_numpy()
        out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for group in rows.groupby(["hub", "i", "j"], sort=False).indices.values():
            ys = group[as_y[group]]
            at = np.repeat(first[ys] - np.cumsum(held[ys]) + held[ys], held[ys]) + np.arange(held[ys].sum())
            of = np.repeat(np.arange(len(ys)), held[ys])
            order = np.argsort(tokens[at], kind="stable")
            at, of = at[order], of[order]
            sorted_ = tokens[at]
            for x in group[as_x[group]]:
                mine = np.arange(first[x], first[x] + held[x])
                start, end = np.searchsorted(sorted_, tokens[mine], "left"), np.searchsorted(sorted_, tokens[mine], "right")
                many = end - start
                hit = np.repeat(start - np.cumsum(many) + many, many) + np.arange(many.sum())
                shared = np.bincount(of[hit], np.repeat(weights[mine], many), len(ys))
                rest = np.full(len(ys), np.iinfo(np.int64).max)
                np.minimum.at(rest, of[hit], np.minimum(np.repeat(after[mine], many), after[at[hit]]))
                low, high = np.minimum(ns[x], ns[ys]), np.maximum(ns[x], ns[ys])
                need = np.ceil((low + high) * (least / (1 + least)) - BOUND_SLACK)
                enough = shared >= np.maximum(need - np.ceil(high * least - BOUND_SLACK) + 1, 1)
                enough[enough] &= shared[enough] + rest[enough] >= need[enough]
                enough &= (high <= np.floor(low / least + BOUND_SLACK)) & (parts[ys] != parts[x]) & ~(np.abs(away[ys] - away[x]) > 1 - least + 1e-9)
                out_a.append(np.minimum(fps[x], fps[ys[enough]]))
                out_b.append(np.maximum(fps[x], fps[ys[enough]]))
        give_back()
        return pa.table({"a": np.concatenate(out_a), "b": np.concatenate(out_b)})

    return tally


def _crossing(measured: DataFrame, open_: DataFrame, members: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of one hub, not both of its main component, that may be alike though they share no short list.

    Members meet in blocks of HUB_BLOCK within a task, so that pairs which don't share enough are never written.
    """
    own = members.groupBy("fp").agg(F.collect_list(F.struct("token", "weight", "place")).alias("own"))
    blocks = lambda name: F.ceil(F.col(name) / HUB_BLOCK).cast("int")
    rows = measured.select("hub", "fp", "n", "part", "away", (F.col("part") != F.col("main")).alias("other"), blocks("others").alias("is"), blocks("held").alias("js"))
    rows = rows.withColumn("i_", F.pmod(F.xxhash64("fp"), "is").cast("int")).withColumn("j_", F.pmod(F.xxhash64("fp"), "js").cast("int")).join(own, "fp")
    # Each of the others meets every block of members, each member every block of the others.
    cells = F.transform(F.sequence(F.lit(0), F.col("is") - 1), lambda i: F.struct(i.alias("i"), F.col("j_").alias("j")))
    across = F.transform(F.sequence(F.lit(0), F.col("js") - 1), lambda j: F.struct(F.col("i_").alias("i"), j.alias("j")))
    rows = rows.withColumn("cell", F.explode(F.when(F.col("other"), F.array_union(cells, across)).otherwise(cells)))
    dealt = rows.select("hub", "cell.i", "cell.j", "fp", "n", "part", "away", (F.col("other") & (F.col("cell.i") == F.col("i_"))).alias("as_x"), (F.col("cell.j") == F.col("j_")).alias("as_y"), "own")
    deals = 1 + open_.agg(F.sum("held")).first()[0] // (4 * HUB_BLOCK) if not open_.isEmpty() else 1
    return dealt.groupBy(F.pmod(F.xxhash64("hub", "i", "j"), F.lit(deals)).alias("deal")).applyInArrow(_shared(least), "a long, b long")


def by_fingerprint(rows: DataFrame, bits: int) -> DataFrame:
    """(a, b): pairs of sets in rows (fp, sim) that connect all whose fingerprints differ in at most bits bits, by op5's index."""
    held = staged(rows.select("sim", "fp").distinct(), "sims")
    nodes = staged(held.groupBy("sim").agg(F.min("fp").alias("least")), "sim-nodes")
    node = lambda side: nodes.select(F.col("sim").alias(f"{side}_sim"), F.col("least").alias(side))
    near = simhash.links(nodes.select(F.col("sim").alias("fp")), bits=bits).select(F.col("a").alias("a_sim"), F.col("b").alias("b_sim"))
    same = held.join(nodes, "sim").select(F.col("least").alias("a"), F.col("fp").alias("b"))
    return staged(near.join(node("a"), "a_sim").join(node("b"), "b_sim").select("a", "b").unionByName(same).where("a <> b").distinct(), "sim-pairs")


def links(docs: DataFrame, found: DataFrame, shingle: int, least: float, common: np.ndarray, list_most: int = LIST_MOST, bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """(doc_id, tie, fp) of each row, and (a, b): links between different sets that connect all of coefficient least or more."""
    entries = found.agg(F.sum(F.octet_length("prefix") / TOKEN_BYTES)).first()[0] or 0
    parts = 1 + int(entries) // PART_ENTRIES
    met = staged(_dealt(found, parts, common).groupBy("part").applyInArrow(_met(least, list_most), CANDIDATES), "candidates")
    rows = staged(found.select("doc_id", "tie", "fp", "sim"), "set-ids")
    discard(found)
    similar = by_fingerprint(rows, bits)
    settle(docs.sparkSession)
    first = rows.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").cast("string").alias("doc_id"), "tie")).alias("first"))
    named = staged(first.select("fp", "first.doc_id", "first.tie"), "set-rows")

    # A set's tokens in long lists may be shared with anyone there.
    members = met.where("token is not null").select("token", F.col("a").alias("fp"), F.col("an").alias("n"), "weight", "place")
    loads = staged(members.groupBy("fp").agg(F.sum("weight").alias("load")), "loads")
    load_of = lambda side: loads.select(F.col("fp").alias(side), F.col("load").alias(f"{side}_load"))
    tally = met.where("token is null").groupBy("a", "b").agg(F.max("an").alias("an"), F.max("bn").alias("bn"), F.sum("weight").alias("shared"))
    more = F.least(F.coalesce("a_load", F.lit(0)), F.coalesce("b_load", F.lit(0)))
    enough = F.col("shared") + more >= least_shared(F.col("an"), F.col("bn"), least)
    near = staged(tally.join(load_of("a"), "a", "left").join(load_of("b"), "b", "left").where(enough).select("a", "b"), "near-pairs")
    loaded = staged(members.drop("weight", "place").join(loads, "fp"), "long-members")
    # What a group of near copies was made from shares most of its tokens with the others: a good hub.
    lists = loaded.groupBy("token").agg(F.count(F.lit(1)).alias("held"), F.max(F.struct("load", "fp", "n")).alias("hub")).where("held > 1")
    long = join_by_key(loaded, staged(lists, "token-lists"), "token", "held", loaded.count())
    long = staged(long.select("token", "fp", "n", "load", F.col("hub.fp").alias("hub"), F.col("hub.n").alias("hub_n")), "long-index")

    can = lambda x, y: within_size_window(F.col(x), F.col(y), least)
    spokes = long.where(F.col("fp") != F.col("hub")).where(can("n", "hub_n") & (F.col("load") >= least_shared(F.col("n"), F.col("hub_n"), least)))
    # Pairs by fingerprint come first; a set that they leave alone is compared with the least that it shares enough with.
    alone = near.join(similar.select("b").distinct(), "b", "left_anti")
    stars = alone.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    pairs = staged(similar.unionByName(stars).unionByName(spokes.select(F.col("hub").alias("a"), F.col("fp").alias("b"))).distinct(), "first-pairs")
    scored = staged(_scored(pairs, docs, named, shingle), "scored")
    alike = scored.where(F.col("score") >= F.lit(least)).select("a", "b")

    parts_of = staged(connected_components(alike), "parts")
    settle(docs.sparkSession)
    joined = parts_of.select(F.col("component").alias("a"), F.col("node").alias("b"))
    sizes = parts_of.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    sized = staged(join_by_key(parts_of, sizes, "component", "size", parts_of.count()).drop("size"), "sized-parts")
    part = lambda side: sized.select(F.col("node").alias(side), F.col("component").alias(f"{side}_part"))
    apart = near.join(part("a"), "a", "left").join(part("b"), "b", "left").where(F.coalesce("a_part", "a") != F.coalesce("b_part", "b")).select("a", "b")
    # Lists of one hub are one set of members, in which a pair comes once. Those outside its largest component meet
    # the members of the other components.
    known = long.select("hub", "fp", "n", "load").distinct().join(sized.withColumnRenamed("node", "fp"), "fp", "left")
    known = staged(known.withColumn("part", F.coalesce("component", "fp")).drop("component"), "hub-members")
    counts = known.groupBy("hub", "part").agg(F.count(F.lit(1)).alias("m"))
    main = counts.groupBy("hub").agg(F.max(F.struct("m", "part")).alias("top"), F.count(F.lit(1)).alias("parts"), F.sum("m").alias("held"))
    open_ = staged(main.where("parts > 1").select("hub", F.col("top.part").alias("main"), "held", (F.col("held") - F.col("top.m")).alias("others")), "open-hubs")
    inside = join_by_key(known, open_, "hub", "held", known.count())
    hubs = scored.select(F.col("a").alias("hub"), F.col("b").alias("fp"), (F.lit(1.0) - F.col("score")).alias("away"))
    measured = staged(inside.join(hubs, ["hub", "fp"], "left").withColumn("away", F.when(F.col("fp") == F.col("hub"), 0.0).otherwise(F.col("away"))), "measured")
    cross = _crossing(measured, open_, members, least)
    done = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    crossing = staged(apart.unionByName(cross).distinct().join(done, ["a", "b"], "left_anti"), "second-pairs")
    discard(met)
    settle(docs.sparkSession)
    rows = rows.drop("sim")
    if crossing.isEmpty():
        return rows, joined
    again = _scored(crossing, docs, named, shingle)
    return rows, staged(joined.unionByName(again.where(F.col("score") >= F.lit(least)).select("a", "b")), "near-links")


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, least: float = LEAST, list_most: int = LIST_MOST, bits: int = BITS) -> DataFrame:
    """The rows of docs that stand for their group of near copies: its smallest id, one row where ids repeat."""
    settle(docs.sparkSession)
    common = common_tokens(docs, shingle)
    found = staged(described(docs, shingle, least, common), "shingles")
    rows, near = links(docs, found, shingle, least, common[0], list_most, bits)
    settle(docs.sparkSession)
    return representatives(docs, labelled(rows, near=near))
