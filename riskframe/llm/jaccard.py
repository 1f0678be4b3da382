"""N-gram Jaccard join with a token-group matrix (operator 8).

A document is the set of the 64-bit hashes of its distinct word shingles; two link when their Jaccard similarity is at
least `percent` hundredths. The result is exact: the components of all links.

1. Documents with equal sets are one class; one of them, the smallest doc_id, stands for it.
2. Similar documents are partitioned into groups by min-hash values. A group is first opened for its smallest member only
   (a star, not all pairs), which joins most similar documents into provisional components at linear cost.
3. Groups of the matrix are slices of about `slice_rows` documents of a provisional component, or of documents outside
   any whose most frequent min-hash value is the same. The matrix holds for
   each group the union of its members' prefix tokens: with size n, any partner shares one of the first
   n - ceil(t n) + 1 tokens in a common order. Tokens that lie in one component only are dropped. Frequent tokens go to
   the end of the order, so a passage that many documents share does not make all of them candidates.
4. A document is a query to its own group and those before it that share a prefix token and fit in size. The group's full
   token union bounds the overlap with any member; only groups whose bound reaches t times the query's size are opened
   and compared member by member. One match settles a component. Before whole sets are sent to groups, parity maps of the
   sets, about a fiftieth of their size, are: queries and members whose maps rule out every link of the group are left.
5. Components of all links found.

Defined results. Null or empty text, or one without words: an empty set, linked with nothing, its own component.
Fewer words than a shingle: the whole sequence is one. Null doc_id: no links, null component. Rows with one doc_id are
one document, a row each in the result. Empty table: no rows. Long texts: whole. Extra columns stay in `keep_one`.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .components import components

#: Min-hash values of a document, and how many of them group documents.
VALUES, BANDS = 16, 6
#: Bits of a set's parity map.
BITS = 1024
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Odd multipliers, one a min-hash value.
_ODD = np.array([(0x9E3779B97F4A7C15 * (2 * i + 1) ^ 0xD6E8FEB86659FD93 * i) & 0xFFFFFFFFFFFFFFFF | 1 for i in range(VALUES)], np.uint64)


class Shingler:
    """Sorted distinct shingle hashes of texts; word hashes are kept."""

    def __init__(self, k: int, keep: int = 250_000):
        self.k, self.keep, self.known = k, keep, {}

    def __call__(self, text: str | None) -> np.ndarray:
        import xxhash

        words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
        known = self.known
        if len(known) > self.keep:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        if not len(h):
            return h
        k, mul = min(self.k, len(h)), np.uint64(0x9FB21C651E98DF25)
        out = h[: len(h) - k + 1].copy()
        for i in range(1, k):
            out = (out ^ (out >> np.uint64(31))) * mul + h[i : len(h) - k + 1 + i]
        out ^= out >> np.uint64(29)
        out *= mul
        return np.unique(out ^ (out >> np.uint64(32)))


def prefix_size(n: int, percent: int) -> int:
    return n + (-n * percent // 100) + 1 if n else 0


def signed(a: np.ndarray) -> np.ndarray:
    return a.view(np.int64)


def parity(s: np.ndarray) -> bytes:
    """A set's parity map, as many bits as items up to the next power of two: the parity of the number of items at each bit. The map of half the bits is the exclusive or of its halves."""
    bits = max(64, 1 << (len(s) - 1).bit_length()) if len(s) else 64
    count = np.bincount((s >> np.uint64(40)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(count.astype(np.uint8)).tobytes()


def folded(maps: np.ndarray, words: int) -> np.ndarray:
    """Parity maps (64-bit words in the last axis) with so many words."""
    while (half := maps.shape[-1] // 2) >= words:
        maps = maps[..., :half] ^ maps[..., half:]
    return maps


def signatures(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, n, key (of the set), mins (min-hash values), prefix (tokens), parity (map)."""

    def make():
        import xxhash

        shingle = Shingler(k)

        def work(batch: pa.RecordBatch) -> dict:
            sets = [shingle(x) for x in batch.column("text").to_pylist()]
            mins = [signed((s[:, None] * _ODD).min(0)) if len(s) else [] for s in sets]
            return {"doc_id": batch.column("doc_id"), "n": [len(s) for s in sets], "key": [xxhash.xxh3_128_digest(s.tobytes()) for s in sets], "mins": [list(m) for m in mins], "prefix": [signed(s[: prefix_size(len(s), percent)]) for s in sets], "parity": [parity(s) for s in sets]}

        return work

    return common.per_batch(docs.select("doc_id", "text"), make, "doc_id long, n long, key binary, mins array<long>, prefix array<long>, parity binary")


def of_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id, text of the documents with these ids (column node): few ids are sent to the texts, else both are shuffled."""
    few = common.small(ids, 1_000_000)
    ids = ids.select(F.col("node").alias("doc_id"))
    return docs.select("doc_id", "text").join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")


def sets_of(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """node, items (the set's hashes as bytes)."""

    def make():
        shingle = Shingler(k)
        return lambda batch: {"node": batch.column("doc_id"), "items": [shingle(x).tobytes() for x in batch.column("text").to_pylist()]}

    return common.per_batch(of_ids(docs, ids), make, "node long, items binary")


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Common items of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(b) else 0


def parities(sets: list[np.ndarray]) -> np.ndarray:
    """BITS bits a set: the parity of the number of its items at each bit. Two sets differ in at least as many items as their bits differ."""
    out = np.zeros((len(sets), BITS // 64), np.uint64)
    for i, s in enumerate(sets):
        count = np.bincount((s >> np.uint64(40)).astype(np.int64) % BITS, minlength=BITS) & 1
        out[i] = np.packbits(count.astype(np.uint8)).view(np.uint64)
    return out


def open_groups(group: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links of a group's queries (role 1) to its members (role 0); at most one for each component (root) of members."""
    sets = [np.frombuffer(x, np.uint64) for x in group["items"]]
    nodes, roles, roots = (group[c].to_numpy() for c in ("node", "role", "root"))
    members, queries = np.flatnonzero(roles == 0), np.flatnonzero(roles == 1)
    out = []
    if len(members) and len(queries):
        union = np.unique(np.concatenate([sets[i] for i in members])) if len(members) > 1 else sets[members[0]]
        sizes, bits = np.array([len(s) for s in sets]), parities(sets)
        for q in queries:
            n = len(sets[q])
            if 100 * overlap(sets[q], union) < percent * n:
                continue
            most = most_differing(n, sizes[members], percent)
            near = members[(np.bitwise_count(bits[members] ^ bits[q]).sum(1, dtype=np.int64) <= most) & (roots[members] != roots[q])]
            known = set()
            for m in near:
                size = len(sets[m])
                if roots[m] not in known and 100 * min(n, size) >= percent * max(n, size):
                    common_items = overlap(sets[q], sets[m])
                    if 100 * common_items >= percent * (n + size - common_items):
                        out.append((nodes[q], nodes[m]))
                        known.add(roots[m])
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def most_differing(n: int, sizes: np.ndarray, percent: int) -> np.ndarray:
    """In how many items at most a set of n and sets of these sizes differ if they link: at least percent / (100 + percent) of both sizes are in common."""
    both = n + sizes
    return both - 2 * (-(-both * percent // (100 + percent)))


def may_link(group: pd.DataFrame, percent: int) -> pd.DataFrame:
    """grp, node, root, role of a group's queries (role 1) and members (role 0) that by sizes and parity maps may link across roots; no link is lost."""
    n, roles, roots = (group[c].to_numpy(np.int64) for c in ("n", "role", "root"))
    maps = [np.frombuffer(x, np.uint64) for x in group["parity"]]
    words = np.array([len(x) for x in maps])
    tables = {}
    for w in np.unique(words[roles == 0]).tolist():
        at = np.flatnonzero((roles == 0) & (words == w))
        tables[w, w] = at, np.stack([maps[i] for i in at])
    widths, kept = [w for w, _ in tables], np.zeros(len(group), bool)
    for q in np.flatnonzero(roles == 1).tolist():
        for w in widths:
            at, table = tables[w, w]
            fits = np.flatnonzero((100 * np.minimum(n[at], n[q]) >= percent * np.maximum(n[at], n[q])) & (roots[at] != roots[q]))
            if len(fits):
                least = min(w, int(words[q]))
                if (w, least) not in tables:
                    tables[w, least] = at, folded(table, least)
                apart = np.bitwise_count(tables[w, least][1][fits] ^ folded(maps[q], least)).sum(1, dtype=np.int64)
                if len(near := at[fits[apart <= most_differing(n[q], n[at[fits]], percent)]]):
                    kept[q] = kept[near] = True
    return group.loc[kept, ["grp", "node", "root", "role"]]


def sifted(maps: DataFrame, members: DataFrame, queries: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """The members and queries (grp, node, root) that the maps (node, n, parity) leave. Growing tables share ever more tokens by chance, so most groups asked hold no link; whole sets are sent for the rest only."""
    rows = dealt(members, queries)
    full = maps.join(F.broadcast(rows) if common.small(rows, 1_000_000) else rows, "node")
    left = common.cut(full.groupBy("grp", "salt").applyInPandas(lambda g: may_link(g, percent), "grp long, node long, root long, role int"))
    common.forget(rows)
    return tuple(left.filter(F.col("role") == role).select("grp", "node", "root").distinct() for role in (0, 1))


def dealt(members: DataFrame, queries: DataFrame) -> DataFrame:
    """grp, salt, node, root, role (0 of members, 1 of queries), cut. A group's queries are split over salts, its few members go to each."""
    salts = 8
    queries = common.cut(queries)
    counted = queries.groupBy("grp").agg(F.count("*").alias("c"))
    # only groups with more queries than a task should hold are split
    parts = counted.select("grp", F.least(F.lit(4096), F.ceil(F.col("c") / 256)).cast("int").alias("parts"))
    ask = common.salted_join(queries, parts, ["grp"], "node", salts).withColumn("salt", F.pmod(F.xxhash64("node", F.lit(3)), F.col("parts")).cast("int"))
    hold = members.join(parts, "grp").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = ask.select("grp", "salt", "node", "root", F.lit(1).alias("role")).unionByName(hold.select("grp", "salt", "node", "root", F.lit(0).alias("role")))
    return common.cut(rows)


def verified(docs: DataFrame, members: DataFrame, queries: DataFrame, k: int, percent: int) -> DataFrame:
    """Links a, b of queries (grp, node, root) to members (grp, node, root)."""
    rows = dealt(members, queries)
    items = sets_of(docs, common.cut(rows.select("node").distinct()), k)
    full = items.join(F.broadcast(rows) if common.small(rows, 1_000_000) else rows, "node")
    return full.groupBy("grp", "salt").applyInPandas(lambda g: open_groups(g, percent), "a long, b long")


def stars(reps: DataFrame, percent: int) -> DataFrame:
    """member, hub: each document and the smallest one with which it shares a min-hash value, where sizes allow a link and over half of all values agree. What this misses is left to the matrix."""
    values = reps.select(F.col("doc_id").alias("node"), "n", "mins", F.posexplode(F.slice("mins", 1, BANDS)).alias("band", "value"))
    hubs = values.groupBy("band", "value").agg(F.min(F.struct("node", "n", "mins")).alias("hub"), F.max("node").alias("most")).filter(F.col("most") > F.col("hub.node")).select("band", "value", "hub")
    found = common.salted_join(values, hubs, ["band", "value"], "node", 4)
    alike = F.size(F.filter(F.zip_with("mins", "hub.mins", lambda a, b: a == b), lambda x: x)) > VALUES // 2
    fits = (F.col("node") != F.col("hub.node")) & (F.least("n", "hub.n") * 100 >= F.greatest("n", "hub.n") * percent) & alike
    return found.filter(fits).select(F.col("node").alias("member"), F.col("hub.node").alias("hub")).distinct()


def reordered(docs: DataFrame, ids: DataFrame, hot: np.ndarray, k: int, percent: int) -> DataFrame:
    """doc_id, n, prefix of these documents with the hot tokens last in the order."""
    sent = docs.sparkSession.sparkContext.broadcast(hot)

    def make():
        shingle, late = Shingler(k), sent.value

        def first(text: str | None) -> tuple[int, np.ndarray]:
            s = shingle(text)
            at = np.searchsorted(late, s)
            at[at == len(late)] = 0
            is_hot = late[at] == s
            return len(s), signed(np.concatenate((s[~is_hot], s[is_hot]))[: prefix_size(len(s), percent)])

        def work(batch: pa.RecordBatch) -> dict:
            done = [first(x) for x in batch.column("text").to_pylist()]
            return {"doc_id": batch.column("doc_id"), "n": [d[0] for d in done], "prefix": [d[1] for d in done]}

        return work

    return common.per_batch(of_ids(docs, ids), make, "doc_id long, n long, prefix array<long>")


def by_value(reps: DataFrame, slice_rows: int) -> DataFrame:
    """node, own: a group for each document that shares a min-hash value, by the most frequent of its values, so that variants of one text come into few groups."""
    values = reps.select(F.col("doc_id").alias("node"), F.explode(F.slice("mins", 1, BANDS)).alias("value"))
    shared = values.groupBy("value").agg(F.count("*").alias("c")).filter("c > 1")
    best = common.salted_join(values, shared, ["value"], "node", 4).groupBy("node").agg(F.max(F.struct("c", "value")).alias("best"))
    return best.select("node", F.xxhash64("best.value", F.pmod(F.xxhash64("node"), F.ceil(F.col("best.c") / slice_rows)), F.lit("value")).alias("own"))


def candidates(docs: DataFrame, reps: DataFrame, comps: DataFrame, k: int, percent: int, hot_rows: int, slice_rows: int) -> tuple[DataFrame, DataFrame]:
    """Members (grp, node) and queries (grp, node) between provisional components."""
    sizes = comps.groupBy("root").agg((F.count("*") + 1).alias("size"))
    placed = comps.join(sizes, "root").select("node", "root", "size").unionByName(sizes.select(F.col("root").alias("node"), "root", "size"))
    placed = placed.withColumn("own", F.xxhash64("root", F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / slice_rows)))).drop("size")
    valued = by_value(reps, slice_rows).select("node", F.lit(None).cast("long").alias("root"), "own")
    # a document of a component is grouped by it, any other by its value
    placed = common.cut(placed.unionByName(valued).groupBy("node").agg(F.max("root").alias("root"), F.max_by("own", F.col("root").isNotNull()).alias("own")))
    placed = F.broadcast(placed) if common.small(placed, 500_000) else placed

    def with_group(rows: DataFrame) -> DataFrame:
        """node, n, prefix, root, grp; a document without a group is one alone."""
        out = rows.withColumnRenamed("doc_id", "node").join(placed, "node", "left")
        return out.select("node", "n", "prefix", F.coalesce("root", "node").alias("root"), F.coalesce("own", F.xxhash64("node", F.lit("alone"))).alias("grp"))

    first = with_group(reps.select("doc_id", "n", "prefix"))
    rows, hot, counted, used = first, np.zeros(0, np.uint64), None, []
    for turn in range(2):
        tokens = rows.select("node", "root", F.explode("prefix").alias("token"))
        counted = common.cut(tokens.groupBy("token").agg(F.count("*").alias("c"), F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 <> r1").select("token", "c"))
        used.append(counted)
        if turn:
            break
        limit = hot_rows
        while (new := counted.filter(F.col("c") > limit)).count() > 200_000:  # the list of hot tokens has a fixed size
            limit *= 4
        # at most 200 000 tokens; they only set the order, so the limit changes no result
        hot = np.sort(np.array([r[0] for r in new.select("token").collect()], np.int64).view(np.uint64))
        if not len(hot):
            break
        ids = common.cut(tokens.join(F.broadcast(new.select("token")), "token").select("node").distinct())
        used += [ids, common.cut(reordered(docs, ids, hot, k, percent))]
        changed = used[-1].dropDuplicates(["doc_id", "n", "prefix"])
        rest = first.join(F.broadcast(ids) if common.small(ids, 1_000_000) else ids, "node", "left_anti")
        rows = rest.unionByName(with_group(changed))
    common.settle(docs.sparkSession)  # the shuffles of the counts
    both = counted.select("token")
    # only node and token are shuffled with the tokens; what else a document has joins the few that stay
    posts = rows.select("node", F.explode("prefix").alias("token")).join(F.broadcast(both) if common.small(both, 1_000_000) else both, "token")
    size = F.col("n") - F.expr(f"(n * {percent} + 99) div 100") + 1  # prefix_size
    about = rows.select("node", "n", "root", "grp", size.cast("int").alias("p")).distinct()
    posts = posts.withColumn("s", F.count("*").over(Window.partitionBy("node"))).join(about, "node")
    # of a linked pair's prefixes the one that ends first in the order is wholly known to the other document: its tokens
    # that no other component has are missing there, so that document must reach the threshold without them
    posts = common.cut(posts.withColumn("strong", (F.col("n") - F.col("p") + F.col("s")) * 100 >= F.col("n") * percent).drop("s"))
    for df in used:
        common.forget(df)
    found = asked_groups(posts, percent)
    common.forget(posts)
    return found


def asked_groups(posts: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Members (grp, node, root) and queries (grp, node, root) of the pairs of groups that may hold a link.

    The matrix first meets itself, group by group, so a token that many documents share costs its groups and not its
    documents. Of two groups the smaller one's documents are the queries; each then meets the other's row of the matrix.
    """
    common.settle(posts.sparkSession)
    rest = F.col("n") - F.col("p")
    matrix = posts.groupBy("token", "grp").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.min("n").alias("least"), F.max("n").alias("most"), F.max(rest).alias("rest"), F.max("strong").alias("strong"))
    matrix = common.cut(matrix)
    a, b = matrix.alias("a"), matrix.alias("b")
    one_root = (F.col("a.r0") == F.col("b.r1")) & (F.col("a.r1") == F.col("b.r0")) & (F.col("a.r0") == F.col("a.r1"))
    fits = (F.col("a.grp") >= F.col("b.grp")) & ~one_root & (F.col("a.strong") | F.col("b.strong"))
    fits = fits & (F.col("a.least") * percent <= F.col("b.most") * 100) & (F.col("b.least") * percent <= F.col("a.most") * 100)
    met = a.join(b, (F.col("a.token") == F.col("b.token")) & fits).groupBy(F.col("a.grp").alias("g1"), F.col("b.grp").alias("g2"))
    met = met.agg(F.count("*").alias("c"), F.min("a.least").alias("least1"), F.min("b.least").alias("least2"), F.max(F.greatest("a.rest", "b.rest")).alias("rest"))
    pairs = met.filter((F.col("rest") + F.col("c")) * (100 + percent) >= (F.col("least1") + F.col("least2")) * percent).select("g1", "g2")
    documents = common.cut(posts.groupBy("grp", "node", "root", "n", "p", "strong").agg(F.collect_set("token").alias("tokens")))
    sizes = documents.groupBy("grp").agg(F.count("*").alias("size"))
    for side in ("1", "2"):
        pairs = pairs.join(sizes.select(F.col("grp").alias(f"g{side}"), F.col("size").alias(f"s{side}")), f"g{side}")
    less = F.struct("s1", "g1") <= F.struct("s2", "g2")
    pairs = common.cut(pairs.select(F.when(less, F.col("g1")).otherwise(F.col("g2")).alias("asks"), F.when(less, F.col("g2")).otherwise(F.col("g1")).alias("grp")))
    line = matrix.groupBy("grp").agg(F.min("least").alias("least"), F.max("most").alias("most"), F.max("rest").alias("rest"), F.collect_list("token").alias("tokens"), F.collect_list("strong").alias("strongs"))
    lines = pairs.join(line, "grp").select("asks", "grp", "least", "most", "rest", "tokens", "strongs")
    one = documents.join(pairs.select(F.col("asks").alias("grp")).distinct(), "grp", "left_semi").withColumnRenamed("grp", "asks")
    # no nulls in numbers: pandas would make them floats
    one = one.withColumns({"role": F.lit(0), "grp": F.lit(0).cast("long"), "least": F.lit(0).cast("long"), "most": F.lit(0).cast("long"), "rest": F.col("n") - F.col("p")})
    lines = lines.withColumns({"role": F.lit(1), "node": F.lit(0).cast("long"), "root": F.lit(0).cast("long"), "n": F.lit(0).cast("long"), "p": F.lit(0), "strong": F.lit(False)})
    rows = common.cut(one.withColumn("strongs", F.array().cast("array<boolean>")).unionByName(lines))
    parts = max(2, int(posts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // 20_000))
    asked = rows.withColumn("bucket", F.pmod(F.xxhash64("asks"), F.lit(parts))).groupBy("bucket").applyInPandas(lambda g: reachable(g, percent), "grp long, node long, root long")
    asked = common.cut(asked)
    members = common.cut(documents.select("grp", "node", "root").distinct().join(asked.select("grp").distinct(), "grp", "left_semi"))
    for df in (matrix, documents, pairs, rows):
        common.forget(df)
    return members, asked


def reachable(rows: pd.DataFrame, percent: int) -> pd.DataFrame:
    """grp, node, root of the documents (role 0) whose prefix lets a member of a group (role 1) reach the threshold. Both have asks, the group of the document."""
    is_doc = rows["role"].to_numpy() == 0
    out = []
    lines = dict(list(rows[~is_doc].groupby("asks")))
    for asks, docs in rows[is_doc].groupby("asks"):
        counts = docs["tokens"].map(len).to_numpy()
        flat, of = np.concatenate(docs["tokens"].to_numpy()), np.repeat(np.arange(len(docs)), counts)
        n, rest = docs["n"].to_numpy(np.int64), docs["rest"].to_numpy(np.int64)
        firm, nodes, roots = docs["strong"].to_numpy(bool), docs["node"].to_numpy(np.int64), docs["root"].to_numpy(np.int64)
        order = np.argsort(flat, kind="stable")
        flat, of = flat[order], of[order]
        for x in lines[asks].itertuples(index=False):
            tokens, strongs = np.asarray(x.tokens), np.asarray(x.strongs, bool)
            low, high = np.searchsorted(flat, tokens), np.searchsorted(flat, tokens, "right")
            places = np.concatenate([np.arange(i, j) for i, j in zip(low.tolist(), high.tolist(), strict=True)])
            strong = np.repeat(strongs, high - low)
            owner = of[places]
            c = np.bincount(owner[strong | firm[owner]], minlength=len(docs))
            fits = (c > 0) & (n * percent <= int(x.most) * 100) & (int(x.least) * percent <= n * 100)
            fits &= (np.maximum(rest, int(x.rest)) + c) * (100 + percent) >= (n + int(x.least)) * percent
            out.append((np.full(int(fits.sum()), int(x.grp)), nodes[fits], roots[fits]))
    grp, node, root = (np.concatenate(c).astype(np.int64) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3
    return pd.DataFrame({"grp": grp, "node": node, "root": root})


def classes(docs: DataFrame, k: int = 4, percent: int = 85, hot_rows: int = 32, slice_rows: int = 256) -> DataFrame:
    """doc_id, n_shingles, component_id of each row of docs(doc_id, text)."""
    common.prepare(docs.sparkSession)
    rows = common.cut(signatures(docs, k, percent))
    linkable = rows.filter("n > 0 AND doc_id IS NOT NULL")
    same = common.cut(linkable.groupBy("key").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("most")).filter("most > rep").select("key", "rep"))
    equal = common.salted_join(linkable.select("key", "doc_id"), same, ["key"], "doc_id").filter("doc_id > rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).distinct()
    equal = common.cut(equal)
    copies = equal.select(F.col("a").alias("doc_id"))
    reps = linkable.join(F.broadcast(copies) if common.small(copies, 1_000_000) else copies, "doc_id", "left_anti").drop("key")
    star = common.cut(stars(reps, percent))
    hubs = star.select(F.col("hub").alias("grp"), F.col("hub").alias("node"), F.col("hub").alias("root")).distinct()
    near = common.cut(verified(docs, hubs, star.select(F.col("hub").alias("grp"), F.col("member").alias("node"), F.col("member").alias("root")), k, percent))
    common.settle(docs.sparkSession)
    members, queries = candidates(docs, reps, components(near), k, percent, hot_rows, slice_rows)
    common.settle(docs.sparkSession)
    members, queries = sifted(reps.select(F.col("doc_id").alias("node"), "n", "parity"), members, queries, percent)
    cross = verified(docs, members, queries, k, percent)
    common.settle(docs.sparkSession)
    roots = components(near.unionByName(cross).unionByName(equal))
    known = roots.select(F.col("node").alias("doc_id"), "root")
    out = rows.select("doc_id", "n").join(F.broadcast(known) if common.small(known, 1_000_000) else known, "doc_id", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, all columns, whose doc_id is the smallest of its component (null ids stay)."""
    gone = common.cut(classes(docs, k, percent).filter("component_id < doc_id").select("doc_id").distinct())
    return docs.join(F.broadcast(gone) if common.small(gone, 1_000_000) else gone, "doc_id", "left_anti").select(*docs.columns)


def op8_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return classes(common.read(spark, sf_dir, "documents"))


SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
  ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS sh FROM w),
t AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS c FROM t a JOIN t b ON a.x = b.x AND a.doc_id < b.doc_id
  AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY ALL),
l AS (SELECT a, b FROM p WHERE 100 * c >= 85 * (na + nb - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (WITH RECURSIVE reach(a, b) AS (SELECT a, b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a) SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT s.doc_id, len(s.sh)::BIGINT AS n_shingles, least(s.doc_id, coalesce(r.m, s.doc_id)) AS component_id FROM s LEFT JOIN r ON s.doc_id = r.a
"""
