"""N-gram Jaccard join by chosen paths.

Each text is the set of its runs of ``words`` consecutive words (a text of fewer words: one run of all
its words; a text without words links to nothing). Equal sets form one node, however many rows
hold them.

1. Chosen paths. A set is sampled by TOKENS tokens, coordinate i being the set's token of least i-th
   hash. A run starts all sets in one bucket and splits buckets recursively: in each bucket a few coordinates are
   drawn, the same for all its sets, and a set goes on to a child bucket for each, named after its token there, so sets
   meet again where they share a sampled token. Buckets of one set end; buckets of up to BRUTE
   sets are compared by brute force on the sampled tokens; larger ones split again. One that is
   still larger at DEPTH, whose sets agree in DEPTH drawn tokens, is dealt out as pairs of blocks, so that all its
   pairs are compared, too. The number of
   runs follows from the target recall: a pair at the threshold survives a run with the probability
   of a branching process, and runs are repeated until one of them finds it with that recall. A run
   brings a set to 1 / LAMBDA child buckets in the mean, so the rows of all levels are at most runs x LAMBDA^-DEPTH a
   set (16 x 8.5), in proportion to the sets, whatever the size of a group.
2. Pairs whose sampled tokens agree less often than a pair at the threshold would, but for the bar's share of misses (see
   bar()), are let go; the others join sets into groups.
3. Exact check. Within a group all sets are compared exactly, whatever path brought them there, as
   products of blocks of the set-token table. A group of over BLOCK sets, or of over BLOCK_TOKENS tokens, is dealt out as
   pairs of blocks, so no task holds more than two blocks, and what is passed on is a count of links and a forest
   of them for each block pair, never the pairs themselves. The work in a group of m different near
   copies grows with m^2 / BLOCK in rows; exact copies cost nothing.
4. Verified links give the classes (connected components).

Null doc_id, null text or a text without words: the row is its own class, without links, and keep_one() keeps it. Rows that repeat a
doc_id are rows like others: each goes by its own text, so a doc_id with two texts may have two classes of the
same name. Ties: the first row of a class has the least doc_id, then the least hash of its text. Only doc_id and
text are read; other columns may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinlab.llm import _text as X
from skeinlab.llm.components import connected_components
from skeinlab.storage import drop_table, write_table

WORDS, THRESHOLD, RECALL = 5, 0.8, 0.999
TOKENS, LAMBDA, BRUTE, DEPTH = 64, 0.7, 2048, 6
BLOCK, BLOCK_TOKENS = 512, 1 << 20
_COORDINATES = X.pseudo_random(TOKENS, 3) | np.uint64(1)


def runs_needed(recall: float, threshold: float, depth: int = DEPTH) -> int:
    """Runs after which a pair at the threshold has met, with this recall, in a bucket of the last level."""
    survives = 1.0
    for _ in range(depth):
        survives = 1 - (1 - threshold * survives / (LAMBDA * TOKENS)) ** TOKENS
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - survives)))


def bar(recall: float, threshold: float) -> int:
    """Agreements among TOKENS that a candidate needs: a pair at the threshold misses them in at most half of 1 - recall of all cases."""
    below = 0.0
    for n in range(TOKENS + 1):
        below += math.comb(TOKENS, n) * threshold**n * (1 - threshold) ** (TOKENS - n)
        if below > (1 - recall) / 2:
            return n
    return TOKENS


def _drawn(path: np.ndarray) -> np.ndarray:
    """Which coordinates each bucket draws: each with probability 1 / (LAMBDA * TOKENS), by the bucket's name."""
    x = X.mix64(path[:, None] ^ _COORDINATES[None, :])
    return x < np.uint64(int(2**64 / (LAMBDA * TOKENS)))


def _children(path: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and name of every child bucket; tokens has a row of TOKENS for each path."""
    row, i = np.nonzero(_drawn(path))
    return row, X.mix64(path[row] * np.uint64(0x9E3779B97F4A7C15) + X.mix64(tokens[row, i].astype(np.uint64) ^ _COORDINATES[i]))


def sets(texts: X.Texts, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles, the shingles before each text, and the set's key (0: no words)."""
    start, end, before = texts.words()
    hashes = X.span_hashes(X.BYTE_VALUES[texts.data], start, end)
    values, at = X.distinct_per_text(*X.shingles(hashes, before, words))
    total = np.append(np.zeros(1, np.uint64), np.cumsum(X.mix64(values)))
    n = np.diff(at)
    return values, at, np.where(n > 0, X.mix64(total[at[1:]] - total[at[:-1]] + n.astype(np.uint64)), np.uint64(0))


def _sampled(documents: DataFrame, words: int) -> DataFrame:
    """doc_id, h (hash of the text), key (null: no words or no doc_id), size (of the set), the sampled tokens (TOKENS 32-bit words) and brief, the low byte of each.

    Buckets are compared by brief, which is a quarter as long in the shuffle. Equal tokens have equal bytes, so no
    candidate is lost; unequal ones agree in one of 256 cases, which the exact check sorts out. The
    tokens are minima, so their high bytes are nearly all zero and would not do.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes, rows, briefs = [], [], [], []
            for _, _, texts in X.slices(batch.column("text")):
                values, at, key = sets(texts, words)
                full = np.flatnonzero(np.diff(at))
                least = np.zeros((len(texts), TOKENS), np.uint32)
                if len(full):
                    for i in range(TOKENS):
                        least[full, i] = np.minimum.reduceat(values * _COORDINATES[i], at[full]) >> np.uint64(32)
                keys.append(X.signed(key))
                sizes.append(np.diff(at))
                rows.extend(r.tobytes() for r in least)
                briefs.extend(r.tobytes() for r in least.astype(np.uint8))
            key = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            none = (key == 0) | batch.column("doc_id").is_null().to_numpy(zero_copy_only=False)
            size = np.concatenate(sizes) if sizes else key
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), pa.array(key, pa.int64(), mask=none), pa.array(size, pa.int64()), pa.array(rows, pa.binary(), mask=none), pa.array(briefs, pa.binary(), mask=none)], ["doc_id", "h", "key", "size", "tokens", "brief"])

    return documents.select("doc_id", F.xxhash64("text").alias("h"), "text").mapInArrow(X.tidy(each), "doc_id long, h long, key long, size long, tokens binary, brief binary")


def _matrix(column: pa.Array, dtype: type = np.uint32) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(-1, TOKENS)


def _split(rows: DataFrame, runs: int | None = None) -> DataFrame:
    """(path, key) of the children of (path, key, tokens); with runs, of the root bucket of every run."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                tokens, key = _matrix(part.column("tokens")), part.column("key").to_numpy()
                starts = [part.column("path").to_numpy().view(np.uint64)] if runs is None else [np.full(len(key), r, np.uint64) for r in X.pseudo_random(runs, 4)]
                for path in starts:
                    row, child = _children(path, tokens)
                    yield pa.RecordBatch.from_arrays([pa.array(X.signed(child)), pa.array(key[row])], ["path", "key"])

    return rows.mapInArrow(X.tidy(each), "path long, key long")


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Root of each of n nodes under the links i-j; the root is the least node."""
    root = np.arange(n)
    while len(i):
        low = np.minimum(root[i], root[j])
        np.minimum.at(root, root[i], low)
        np.minimum.at(root, root[j], low)
        root = root[root]
        while (root != root[root]).any():
            root = root[root]
        open_ = root[i] != root[j]
        i, j = i[open_], j[open_]
    return root


def _groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """One batch for each run of rows that agree in the columns names; the rows come sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(n).to_numpy() for n in names]
        edge = np.zeros(batch.num_rows, bool)
        for c in columns:
            edge[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(edge).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            name = tuple(c[a] for c in columns)
            if held and name != last:
                yield held
                held = []
            last = name
            held.append(batch.slice(a, b - a))
    if held:
        yield held


def _without_repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows but those that repeat (grp, x, y, key) of the row before them."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(n).to_numpy() for n in ("grp", "x", "y", "key")]
        new = np.ones(batch.num_rows, bool)
        new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
        new[0] = tuple(c[0] for c in columns) != last
        last = tuple(c[-1] for c in columns)
        yield batch if new.all() else batch.filter(pa.array(new))


def _agreements(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """In how many of the TOKENS bytes the rows agree; the sums of eight flags stay in their bytes."""
    same = np.ascontiguousarray(one == other).view(np.uint64)
    return (np.add.reduce(same, axis=1) * np.uint64(0x0101010101010101)) >> np.uint64(56)


def _pairs(start: np.ndarray, size: np.ndarray, most: int = 1 << 17) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs i < j of the rows of each bucket, about ``most`` at a time."""
    row = np.arange(size.sum()) + np.repeat(start - np.append(0, np.cumsum(size)[:-1]), size)
    after = np.repeat(start + size, size) - row - 1
    total = np.append(0, np.cumsum(after))
    lo = 0
    while lo < len(row):
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + most, "right")) - 1)
        n = after[lo:hi]
        i = np.repeat(row[lo:hi], n)
        yield i, i + 1 + np.arange(total[hi] - total[lo]) - np.repeat(total[lo:hi] - total[lo], n)
        lo = hi


def _roots(brief: np.ndarray, least: int) -> np.ndarray:
    """Root of each set of one large bucket under all links; pairs that are joined already aren't compared again."""
    n = len(brief)
    root = np.arange(n)
    for i in range(n - 1):
        rest = np.flatnonzero(root[i + 1 :] != root[i]) + i + 1
        if not len(rest):
            if (root == root[0]).all():
                break
            continue
        met = np.unique(root[rest[_agreements(brief[rest], brief[i]) >= least]])
        if len(met):
            met = np.append(met, root[i])
            root[np.isin(root, met)] = met.min()
    return root


def _link(path: np.ndarray, brief: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows (row, root) of a forest that joins the sets of each bucket whose sampled tokens agree in ``least`` places; path is sorted."""
    start = np.flatnonzero(np.append(True, path[1:] != path[:-1]))
    size = np.diff(np.append(start, len(path)))
    small = size <= 64
    links = [(np.zeros(0, np.int64),) * 2]
    for i, j in _pairs(start[small], size[small]):
        near = _agreements(brief[i], brief[j]) >= least
        links.append((i[near], j[near]))
    i, j = (np.concatenate(x) for x in zip(*links, strict=True))
    root = _forest(len(path), i, j)
    for a, n in zip(start[~small].tolist(), size[~small].tolist(), strict=True):
        root[a : a + n] = a + _roots(brief[a : a + n], least)
    moved = np.flatnonzero(root != np.arange(len(path)))
    return moved, root[moved]


def _compare_sampled(rows: DataFrame, least: int) -> DataFrame:
    """Links (a, b) that hold together the sets of a bucket (path, part) whose sampled tokens (brief) agree in ``least`` places."""

    def links(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        path, key = (np.concatenate([x.column(n).to_numpy() for x in held]) for n in ("path", "key"))
        i, j = _link(path, np.concatenate([_matrix(x.column("brief"), np.uint8) for x in held]), least)
        return pa.RecordBatch.from_arrays([pa.array(key[i]), pa.array(key[j])], ["a", "b"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            path = batch.column("path").to_numpy()
            last = int(np.searchsorted(path, path[-1]))  # the last bucket may go on in the next batch
            if held and (last or held[0].column("path")[0] != batch.column("path")[0]):
                opens = int(np.searchsorted(path, held[-1].column("path")[0].as_py(), "right"))
                if opens:
                    held.append(batch.slice(0, opens))
                yield links(held)
                held = []
                if opens < last:
                    yield links([batch.slice(opens, last - opens)])
                held = [batch.slice(max(opens, last))]
            else:
                if last:
                    yield links([batch.slice(0, last)])
                held.append(batch.slice(last))
        if held:
            yield links(held)

    return rows.repartition("path").sortWithinPartitions("path").mapInArrow(X.tidy(each), "a long, b long")


def candidates(nodes: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[DataFrame, list[DataFrame]]:
    """Links (a, b) between keys of nodes (key, tokens, brief) that may be as alike as the threshold, and the tables they are read from."""
    own = nodes.select("key", "tokens")
    brief = nodes.select(F.col("key").alias("k"), "brief")
    rows, least = _split(own, runs_needed(recall, threshold)), bar(recall, threshold)
    found, tables = None, []
    for level in range(1, DEPTH + 1):
        buckets = rows.groupBy("path").agg(F.count("*").alias("n")).filter("n > 1").withColumnRenamed("path", "bucket")
        met = write_table(rows.join(buckets, F.col("path") == F.col("bucket")).select("path", "key", "n"), f"paths-{level}")
        tables.append(met)
        large = met.filter(F.col("n") > BRUTE)
        compared = met.filter(F.col("n") <= BRUTE).select("path", "key")
        if level == DEPTH:
            compared = compared.union(_block_pairs(large))
        links = _compare_sampled(compared.join(brief, F.col("key") == F.col("k")).select("path", "key", "brief"), least)
        found = links if found is None else found.union(links)
        if level < DEPTH:
            if large.isEmpty():
                break
            rows = _split(large.join(own.withColumnRenamed("key", "k"), F.col("key") == F.col("k")).select("path", "key", "tokens"))
    return found, tables


def _block_pairs(large: DataFrame) -> DataFrame:
    """(path, key) of the pairs of blocks, of BRUTE / 2 sets each, into which large buckets (path, key, n) are dealt; each pair has a path of its own."""
    nb = F.ceil(F.col("n") / (BRUTE // 2))
    rows = large.withColumn("blk", F.pmod(F.xxhash64("key"), nb)).withColumn("o", F.explode(F.sequence(F.lit(0), nb - 1)))
    return rows.select(F.xxhash64("path", F.least("blk", "o"), F.greatest("blk", "o")).alias("path"), "key")


def _exact(rows: DataFrame, words: int, threshold: float) -> DataFrame:
    """key, links (rows of other sets as alike as the threshold) and root, for each set and block pair.

    rows: grp, x, y (block pair), key, blk, copies, text. Of rows that repeat a key within a block pair one is read.
    """

    def unit(held: list[pa.RecordBatch], x: int, y: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keys, blocks, copies, values, sizes = [], [], [], [], []
        for part in held:
            key, block, n = (part.column(c).to_numpy() for c in ("key", "blk", "copies"))
            for lo, hi, texts in X.slices(part.column("text")):
                v, at, k = sets(texts, words)
                k = X.signed(k)
                for i in range(hi - lo):
                    if key[lo + i] == k[i]:
                        keys.append(key[lo + i])
                        blocks.append(block[lo + i])
                        copies.append(n[lo + i])
                        values.append(v[at[i] : at[i + 1]])
                        sizes.append(at[i + 1] - at[i])
        keys, blocks, copies, sizes = (np.array(v, np.int64) for v in (keys, blocks, copies, sizes))
        n = len(keys)
        if n < 2:
            return keys, np.zeros(n, np.int64), keys
        _, token, df = np.unique(np.concatenate(values), return_inverse=True, return_counts=True)
        of = np.repeat(np.arange(n), sizes)
        shared = df[token] > 1
        token, of = token[shared], of[shared]
        order = np.argsort(token, kind="stable")
        token, of = np.unique(token[order], return_inverse=True)[1], of[order]
        common = np.zeros((n, n), np.float32)
        width = max(1, (1 << 22) // n)
        edges = np.searchsorted(token, np.arange(0, (token[-1] + 1 if len(token) else 0) + width, width))
        for k in range(len(edges) - 1):
            a, b = edges[k], edges[k + 1]
            if a < b:
                part = np.zeros((n, min(width, int(token[b - 1]) - k * width + 1)), np.float32)
                part[of[a:b], token[a:b] - k * width] = 1
                common += part @ part.T
        alike = common >= threshold * (sizes[:, None] + sizes[None, :] - common) - 1e-6 * common
        np.fill_diagonal(alike, False)
        if x != y:
            alike &= blocks[:, None] != blocks[None, :]
        return keys, alike @ copies, keys[_forest(n, *np.nonzero(np.triu(alike)))]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for held in _groups(_without_repeats(batches), ["grp", "x", "y"]):
            out.append(unit(held, held[0].column("x")[0].as_py(), held[0].column("y")[0].as_py()))
            if len(out) > 2000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*out, strict=True)], ["key", "links", "root"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*out, strict=True)], ["key", "links", "root"])

    return rows.repartition("grp", "x", "y").sortWithinPartitions("grp", "x", "y", "key").mapInArrow(X.tidy(each), "key long, links long, root long")


def _classified(documents: DataFrame, words: int, threshold: float, recall: float) -> tuple[DataFrame, DataFrame]:
    """Two written tables: rows (doc_id, h, key) and, for each key, class_id, n_links, and whether it holds its class's first row (doc_id, h)."""
    documents = documents.select("doc_id", "text")
    sampled = write_table(_sampled(documents, words), "sampled")
    first = F.min(F.struct("doc_id", "h")).alias("first")
    nodes = sampled.filter("key IS NOT NULL").groupBy("key").agg(first, F.count("*").alias("copies"), F.max("size").alias("size"), F.min("tokens").alias("tokens"), F.min("brief").alias("brief"))
    nodes = write_table(nodes, "nodes")
    rows = write_table(sampled.select("doc_id", "h", "key"), "rows")
    drop_table(sampled)
    links, paths = candidates(nodes, threshold, recall)
    groups = connected_components(links, "groups")
    for table in paths:
        drop_table(table)
    sizes = groups.join(nodes.select("key", "size"), F.col("node") == F.col("key")).groupBy("component").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("size") / BLOCK_TOKENS)).alias("nb")).withColumnRenamed("component", "g")
    members = groups.withColumnRenamed("component", "grp").join(sizes, F.col("grp") == F.col("g")).withColumn("blk", F.pmod(F.xxhash64("node"), F.col("nb")))
    members = members.join(nodes.select("key", "first", "copies"), F.col("node") == F.col("key")).select("grp", "key", "nb", "blk", F.col("first.doc_id").alias("first_doc"), F.col("first.h").alias("first_h"), "copies")
    members = write_table(members, "members")
    drop_table(groups)
    texts = documents.filter("doc_id IS NOT NULL").hint("merge").join(members, (F.col("doc_id") == F.col("first_doc")) & (F.xxhash64("text") == F.col("first_h"))).select("grp", "key", "nb", "blk", "copies", "text")
    dealt = texts.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).select("grp", F.least("blk", "o").alias("x"), F.greatest("blk", "o").alias("y"), "key", "blk", "copies", "text")
    exact = write_table(_exact(dealt, words, threshold), "exact")
    links = exact.groupBy("key").agg(F.sum("links").alias("links")).withColumnRenamed("key", "k2")
    classes = connected_components(exact.filter("key <> root").select(F.col("key").alias("a"), F.col("root").alias("b")), "classes")
    named = nodes.select("key", "first", "copies").join(classes, F.col("key") == F.col("node"), "left")
    several = named.filter("component IS NOT NULL").groupBy(F.col("component").alias("c")).agg(F.min("first").alias("least"))
    result = named.join(several, F.col("component") == F.col("c"), "left").join(links, F.col("key") == F.col("k2"), "left").withColumn("least", F.coalesce("least", "first"))
    result = result.select("key", F.col("least.doc_id").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"), (F.col("least") == F.col("first")).alias("has_first"), F.col("least.h").alias("class_h"))
    result = write_table(result, "classes")
    for table in (nodes, members, exact, classes):
        drop_table(table)
    return rows, result


def join(documents: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """doc_id, class_id (least doc_id of its class) and n_links of every row.

    n_links counts the other rows whose sets are as alike as the threshold, equal ones among them.
    """
    rows, classes = _classified(documents, words, threshold, recall)
    found = rows.join(classes.withColumnRenamed("key", "k"), F.col("key") == F.col("k"), "left")
    return found.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def keep_one(documents: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """The first row of each class, and every row without doc_id or without words; rows, not doc_ids, go.

    Of rows that agree in doc_id and text one stays; if they differ in other columns, any of them.
    """
    rows, classes = _classified(documents, words, threshold, recall)
    found = rows.join(classes.withColumnRenamed("key", "k"), F.col("key") == F.col("k")).select("doc_id", "h", (F.col("has_first") & (F.col("doc_id") == F.col("class_id")) & (F.col("h") == F.col("class_h"))).alias("stays"))
    found = found.groupBy("doc_id", "h").agg(F.min("stays").alias("stays"), F.count("*").alias("n"))
    marks = write_table(found.filter("NOT stays OR n > 1").select(F.col("doc_id").alias("_doc"), F.col("h").alias("_h"), "stays"), "marks")
    same = (F.col("doc_id") == F.col("_doc")) & (F.xxhash64("text") == F.col("_h"))
    drop_table(rows)
    drop_table(classes)
    out = documents.join(marks, same, "left_anti")
    again = marks.filter("stays")
    if not again.isEmpty():  # a plan for rows that are there twice; it adds no row elsewhere
        out = out.unionByName(documents.join(again, same, "left_semi").withColumn("_text", F.xxhash64("text")).dropDuplicates(["doc_id", "_text"]).drop("_text"))
    return out
