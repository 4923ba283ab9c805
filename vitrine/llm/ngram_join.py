"""N-gram Jaccard join: which documents share at least a given part of their word shingles.

Rare-first prefix filtering. Shingles are ordered by document frequency (in classes that grow by a quarter of a
doubling), then by hash: an order in which a document's first n - ceil(t n) + 1 shingles must hold one of any
partner's. Shingles of a single document come first and find nobody, so a document with enough of them is done
at once; for the rest, documents are joined on the shared shingles of their prefixes. A pair must pass the
length filter, the positional filter and the suffix filter, and is verified once, on whole sets.

Only packed arrays are shuffled: a task sorts the shingle hashes of its documents, cuts them by range and packs
them with zstandard. A range finds the frequencies and hands back the shared shingles alone. Documents of equal
sets have one key and count once from there on, so copies cost nothing more.

A group of near copies would give all its pairs. But linked groups are what is asked for, and inside a group
that is known to be linked no further link changes anything. So each shingle first joins its documents to one
leader, the one with the smallest share of shingles of its own; links found contract into groups. Then all pairs
from different groups that share a prefix shingle and pass the filters (length, position, and the parity of
hashed counts) are checked. No candidate is dropped.
The prefixes are joined in packed ranges, too; shingles of more than ``HOT`` documents, which their frequency
class tells, are joined as rows, which Spark can split.

Shingles and sets are identified by 64-bit hashes (56 bits once the frequency class is in front).

Defined cases: a document without words or text has no shingles and links with nothing; with fewer words than a
shingle, the whole sequence is the one shingle; null identifiers take part but never name a group that has another
id; repeated rows are copies; an empty table gives an empty result. Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from vitrine.llm.common import tasks_of, tidy, tidy_group
from vitrine.llm.components import contract
from vitrine.shared import run_folder, write_out

#: Characters of text whose shingles a task sorts at once, and ranges per shuffle partition: they bound memory only.
SORTED_CHARS, RANGES = 10_000_000, 2
#: Documents of a shingle from which on its postings are rows.
HOT = 20_000
#: Bits of the signature that bounds how much two sets differ.
SIGN_BITS = 256
#: Words that a task remembers the hash of at most.
REMEMBERED = 400_000
_MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


class Hashes(dict):
    """Word to hash, computed once."""

    def __missing__(self, word: bytes) -> int:
        import xxhash
        if len(self) > REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingles(text: str, n: int, hashes: Hashes) -> np.ndarray:
    """Sorted distinct hashes of a whole text's shingles."""
    words = text.encode("utf-8", "replace").lower().split()  # of bytes: A-Z and the six ASCII blanks
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    size = min(n, len(w))
    h = np.full(len(w) - size + 1, size, np.uint64)
    for k in range(size):
        h = h * _MIX[0] + w[k:len(w) - size + 1 + k]
    for shift, factor in ((33, _MIX[1]), (33, _MIX[2])):
        h = (h ^ (h >> np.uint64(shift))) * factor
    return np.unique(h ^ (h >> np.uint64(33)))


def pack(values: np.ndarray) -> bytes:
    """Byte planes under zstandard."""
    import zstandard
    rows = np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize)
    return zstandard.compress(rows.T.tobytes(), 1)


def unpack(body: bytes, kind: str) -> np.ndarray:
    import zstandard
    flat = np.frombuffer(zstandard.decompress(body), np.uint8)
    return np.ascontiguousarray(flat.reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)


def pack_sorted(values: np.ndarray) -> bytes:
    return pack(np.diff(values, prepend=np.uint64(0)))


def unpack_sorted(body: bytes) -> np.ndarray:
    return np.cumsum(unpack(body, "<u8"), dtype=np.uint64)


_PACKED = {"range": pa.int32(), "part": pa.string(), "a": pa.binary(), "b": pa.binary(), "c": pa.binary(), "d": pa.binary()}


def _batch(rows: list[tuple], fields: dict[str, pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, fields.values())], names=list(fields))


def _shingle_task(n: int, ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        hashes, met, part, turn = Hashes(), set(), TaskContext.get().partitionId(), 0
        ids, known, keys, sizes, arrays, owners, chars = [], [], [], [], [], [], 0

        def flush() -> pa.RecordBatch:
            rows = [((part * 31 + turn) % ranges, "documents", pack(np.array(ids, np.int64)), pack(np.array(known, np.uint8)),
                     pack(np.array(keys, np.uint64)), pack(np.array(sizes, np.int64)))]
            if arrays:
                flat = np.concatenate(arrays)
                owner = np.repeat(np.arange(len(arrays), dtype=np.uint32), [len(a) for a in arrays])
                order = np.argsort(flat)
                flat, owner = flat[order], owner[order]
                # equal ranges of the hash
                edges = np.array([(k << 64) // ranges for k in range(1, ranges)], dtype=np.uint64)
                cuts = [0, *np.searchsorted(flat, edges).tolist(), len(flat)]
                own = np.array(owners, np.uint64)
                total = np.array([len(a) for a in arrays], np.uint32)
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    if a < b:
                        here, place = np.unique(owner[a:b], return_inverse=True)
                        kind = np.uint16 if len(here) < 1 << 16 else np.uint32
                        rows.append((k, str(np.dtype(kind)), pack_sorted(flat[a:b]), pack(place.astype(kind)),
                                     own[here].tobytes(), pack(total[here])))
            return _batch(rows, _PACKED)

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                found = shingles(text or "", n, hashes)
                key = xxhash.xxh3_64_intdigest(found.tobytes()) if len(found) else 0
                ids.append(doc_id or 0)
                known.append(doc_id is not None)
                keys.append(key)
                sizes.append(len(found))
                if len(found) and key not in met:  # a copy in the same task adds nothing
                    if len(met) < REMEMBERED:
                        met.add(key)
                    arrays.append(found)
                    owners.append(key)
                    chars += len(text)
                if chars >= SORTED_CHARS or len(ids) >= 200_000:
                    yield flush()
                    ids, known, keys, sizes, arrays, owners, chars = [], [], [], [], [], [], 0
                    turn += 1
        if ids:
            yield flush()
    return run


_FOUND = {"target": pa.int32(), "doc_id": pa.int64(), "n_shingles": pa.int64(), "key": pa.int64(),
          "a": pa.binary(), "b": pa.binary(), "c": pa.binary()}


def _frequency_task(targets: int):
    """One range of hashes: document rows pass; shared shingles go to their documents' targets."""
    def run(group: pa.Table) -> pa.Table:
        out, hashes, keys, sizes = [], [], [], []
        for row in group.to_pylist():
            if row["part"] == "documents":
                ids, known = unpack(row["a"], "<i8").tolist(), unpack(row["b"], "u1").tolist()
                out.append(_batch([(None, i if k else None, n, key, None, None, None) for i, k, key, n in zip(
                    ids, known, unpack(row["c"], "<u8").view(np.int64).tolist(), unpack(row["d"], "<i8").tolist())], _FOUND))
            else:
                place = unpack(row["b"], row["part"])
                hashes.append(unpack_sorted(row["a"]))
                keys.append(np.frombuffer(row["c"], np.uint64)[place])
                sizes.append(unpack(row["d"], "<u4")[place])
        if hashes:
            h, key, size = np.concatenate(hashes), np.concatenate(keys), np.concatenate(sizes)
            order = np.lexsort((key, h))
            h, key, size = h[order], key[order], size[order]
            once = np.append(True, (h[1:] != h[:-1]) | (key[1:] != key[:-1]))  # copies from other tasks
            h, key, size = h[once], key[once], size[once]
            first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            df = np.repeat(np.diff(np.append(first, len(h))), np.diff(np.append(first, len(h))))
            shared = df > 1
            h, key, size, df = h[shared], key[shared], size[shared], df[shared]
            # one number that sorts by frequency class, then by hash
            ranked = (np.floor(4 * np.log2(np.maximum(df, 1))).astype(np.uint64) << np.uint64(56)) | (h >> np.uint64(8))
            target = (key % np.uint64(targets)).astype(np.int32)
            order = np.lexsort((key, target))
            ranked, key, size, target = ranked[order], key[order], size[order], target[order]
            cuts = np.flatnonzero(np.diff(target, prepend=-1, append=targets)).tolist()
            out.append(_batch([(int(target[a]), None, None, None, pack(ranked[a:b]), pack_sorted(key[a:b]), pack(size[a:b]))
                               for a, b in zip(cuts, cuts[1:])], _FOUND))
        return pa.Table.from_batches(out or [_batch([], _FOUND)])
    return run


_SETS = {"key": pa.int64(), "n": pa.int64(), "alone": pa.int64(), "shared": pa.binary(), "prefix": pa.int64()}


def _prefix_task(num: int, den: int):
    """The documents of one target that may have a partner: their shared shingles in order, and how many of these
    belong to the prefix."""
    def run(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        ranked = np.concatenate([unpack(r["a"], "<u8") for r in rows])
        key = np.concatenate([unpack_sorted(r["b"]) for r in rows])
        size = np.concatenate([unpack(r["c"], "<u4") for r in rows]).astype(np.int64)
        order = np.lexsort((ranked, key))
        ranked, key, size = ranked[order], key[order], size[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        n, held = size[first], np.diff(np.append(first, len(key)))
        prefix = n - -(-num * n // den) + 1
        alone = n - held
        out = []
        for k in np.flatnonzero(alone < prefix).tolist():
            own = ranked[first[k]:first[k] + held[k]]
            out.append((int(key[first[k]].view(np.int64)), int(n[k]), int(alone[k]), own.tobytes(),
                        min(int(held[k]), int(prefix[k] - alone[k]))))
        return pa.Table.from_batches([_batch(out, _SETS)])
    return run


# --- candidates -------------------------------------------------------------------
_POSTING = np.dtype([("shingle", "<u8"), ("key", "<i8"), ("group", "<i8"), ("n", "<i4"), ("pos", "<i4"), ("alone", "<i4"),
                     ("parity", "<u8", SIGN_BITS // 64)])
_RAW = f"V{_POSTING.itemsize}"
_POSTINGS = {"range": pa.int32(), "body": pa.binary(), "shingle": pa.int64(), "key": pa.int64(), "group": pa.int64(),
             "n": pa.int64(), "pos": pa.int64(), "own_share": pa.float64()}
_PAIRS = {"a": pa.int64(), "b": pa.int64(), "n_a": pa.int64(), "n_b": pa.int64()}


def _posting_task(ranges: int, hot: int):
    """Prefix postings, packed by range of the hash; those of hot shingles as rows."""
    hottest = np.uint64(int(np.floor(4 * np.log2(hot))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for r in batch.to_pylist():
                own = np.zeros(r["prefix"], _POSTING)
                shared = np.frombuffer(r["shared"], "<u8")
                own["shingle"] = shared[:r["prefix"]]
                own["parity"] = np.packbits(np.bincount(shared & np.uint64(SIGN_BITS - 1), minlength=SIGN_BITS) & 1).view("<u8")
                own["pos"] = r["alone"] + np.arange(r["prefix"])
                for name in ("key", "group", "n", "alone"):
                    own[name] = r[name]
                parts.append(own)
            if not parts:
                continue
            every = np.concatenate(parts)
            is_hot = every["shingle"] >> np.uint64(56) >= hottest
            rows = [(None, None, int(np.int64(x["shingle"].view(np.int64))), int(x["key"]), int(x["group"]), int(x["n"]),
                     int(x["pos"]), float(x["alone"] / x["n"])) for x in every[is_hot]]
            rest = every[~is_hot]
            place = (rest["shingle"] % np.uint64(ranges)).astype(np.int64)
            order = np.argsort(place, kind="stable")
            rest, place = rest[order], place[order]
            cuts = np.flatnonzero(np.diff(place, prepend=-1, append=ranges)).tolist()
            rows += [(int(place[a]), pack(rest[a:b].view(_RAW)), *[None] * 6) for a, b in zip(cuts, cuts[1:])]
            yield _batch(rows, _POSTINGS)
    return run


def _meeting(x: np.ndarray, i: np.ndarray, j: np.ndarray, num: int, den: int) -> np.ndarray:
    """Length, positional and parity filter for postings i and j of one shingle.

    The signature has the parity of the number of shared shingles in each bucket of the hash: a shingle in one
    set only turns one bit, so the bits in which two signatures differ, and the shingles nobody else has, are
    a lower bound of the difference of the sets.
    """
    a, b = x["n"][i].astype(np.int64), x["n"][j].astype(np.int64)
    before = np.minimum(x["pos"][i], x["pos"][j]) + 1
    # shingles of one document only come first and are never common
    before = np.minimum(before, np.minimum(x["pos"][i] - x["alone"][i], x["pos"][j] - x["alone"][j]) + 1)
    rest = np.minimum(a - x["pos"][i], b - x["pos"][j]) - 1
    fit = (den * np.minimum(a, b) >= num * np.maximum(a, b)) & ((num + den) * (before + rest) >= num * (a + b))
    some = np.flatnonzero(fit)
    i, j, total = i[some], j[some], (a + b)[some]
    differ = np.bitwise_count(x["parity"][i] ^ x["parity"][j]).sum(axis=1).astype(np.int64) + x["alone"][i] + x["alone"][j]
    fit[some] = (num + den) * (total - differ) >= 2 * num * total
    return fit


def _pair_task(num: int, den: int, leaders: bool):
    """Candidate pairs of one range: documents with their leader, or all from different groups; each pair once."""
    def run(group: pa.Table) -> pa.Table:
        x = np.concatenate([unpack(r, _RAW).view(_POSTING) for r in group.column("body").to_pylist()])
        x = x[np.lexsort((x["key"], x["alone"] / x["n"], x["shingle"]))]
        first = np.flatnonzero(np.append(True, x["shingle"][1:] != x["shingle"][:-1]))
        ends = np.repeat(np.append(first[1:], len(x)), np.diff(np.append(first, len(x))))
        left, right = [], []

        def meet(i: np.ndarray, j: np.ndarray) -> None:
            apart = x["group"][i] != x["group"][j]
            i, j = i[apart], j[apart]
            fit = _meeting(x, i, j, num, den)
            left.append(i[fit])
            right.append(j[fit])

        if leaders:
            lead = np.repeat(first, np.diff(np.append(first, len(x))))
            others = np.flatnonzero(lead != np.arange(len(x)))
            meet(lead[others], others)
        else:
            here, lag = np.arange(len(x)), 1
            while len(here := here[here + lag < ends[here]]):
                meet(here, here + lag)
                lag += 1
        i, j = (np.concatenate(v) if v else np.zeros(0, int) for v in (left, right))
        swap = x["key"][i] > x["key"][j]
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        pairs = np.unique(np.stack([x["key"][i], x["key"][j], x["n"][i], x["n"][j]], axis=1), axis=0)
        return pa.table([pa.array(pairs[:, k], pa.int64()) for k in range(4)], names=list(_PAIRS))
    return run


def suffix_bound(x: np.ndarray, y: np.ndarray, depth: int = 2) -> int:
    """At least so many values are in only one of two sorted arrays: both are cut at the middle value of one."""
    gap = abs(len(x) - len(y))
    if not depth or not len(x) or not len(y):
        return gap
    middle = y[len(y) // 2]
    i, j = np.searchsorted(x, middle), len(y) // 2
    met = i < len(x) and x[i] == middle
    return (suffix_bound(x[:i], y[:j], depth - 1) + suffix_bound(x[i + met:], y[j + 1:], depth - 1) + (not met))


def _verify_task(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, linked = [], [], []
            for r in batch.to_pylist():
                x, y = np.frombuffer(r["x"], np.uint64), np.frombuffer(r["y"], np.uint64)
                total = r["n_a"] + r["n_b"]
                # shingles of one document only are in neither array of shared ones
                most = (len(x) + len(y) - suffix_bound(x, y)) // 2
                common = most
                if (num + den) * most >= num * total:
                    common = len(np.intersect1d(x, y, assume_unique=True))
                a.append(r["a"])
                b.append(r["b"])
                linked.append((num + den) * common >= num * total)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(linked, pa.bool_())],
                                             names=["a", "b", "linked"])
    return run


class Join:
    """One run over one table; intermediate tables go to the shared folder."""

    def __init__(self, docs: DataFrame, n: int = 5, similarity: str = "0.75"):
        self.spark, t = docs.sparkSession, Fraction(similarity)
        self.num, self.den = t.numerator, t.denominator
        self.folder = run_folder(self.spark, "ngrams")
        self.tasks = tasks_of(self.spark)
        packed = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
            tidy(_shingle_task(n, RANGES * self.tasks)), "range int, part string, a binary, b binary, c binary, d binary")
        found = write_out(packed.groupBy("range").applyInArrow(
            tidy_group(_frequency_task(self.tasks)), "target int, doc_id long, n_shingles long, key long, a binary, b binary, c binary"),
            self.folder, "found")
        self.docs = found.where("target is null").select("doc_id", "n_shingles", "key")
        self.sets = write_out(found.where("target is not null").select("target", "a", "b", "c").groupBy("target").applyInArrow(
            tidy_group(_prefix_task(self.num, self.den)), "key long, n long, alone long, shared binary, prefix long"),
            self.folder, "sets")

    def _fits(self, before) -> Column:
        """Length and positional filter for matching postings; ``before``: common shingles up to the match at most."""
        x, y = F.col("n_a"), F.col("n_b")
        lengths = self.den * F.least(x, y) >= self.num * F.greatest(x, y)
        rest = F.least(x - F.col("pos_a"), y - F.col("pos_b")) - 1
        return lengths & ((self.num + self.den) * (before + rest) >= self.num * (x + y))

    def _verified(self, pairs: DataFrame, name: str) -> DataFrame:
        """a, b, n_a, n_b to a, b, linked."""
        side = lambda key, body: self.sets.select(F.col("key").alias(key), F.col("shared").alias(body))
        both = pairs.select("a", "b", "n_a", "n_b").join(side("b", "y"), "b").join(side("a", "x"), "a")
        return write_out(both.mapInArrow(tidy(_verify_task(self.num, self.den)), "a long, b long, linked boolean"),
                         self.folder, name)

    def _hot_pairs(self, postings: DataFrame, leaders: bool) -> DataFrame:
        """The same candidates for postings that are rows, without the parity; the joins are ones that Spark splits where they are skewed."""
        a = postings.select("shingle", F.col("group").alias("g"), F.col("key").alias("a"), F.col("n").alias("n_a"),
                            F.col("pos").alias("pos_a"), "own_share")
        b = postings.select("shingle", "group", F.col("key").alias("b"), F.col("n").alias("n_b"), F.col("pos").alias("pos_b"))
        if leaders:
            lead = a.groupBy("shingle").agg(F.min(F.struct("own_share", "a", "n_a", "pos_a", "g")).alias("lead"))
            a = lead.select("shingle", "lead.*")
        both = b.join(a, "shingle").where((F.col("g") != F.col("group")) & self._fits(F.least("pos_a", "pos_b") + 1))
        low = F.col("a") < F.col("b")
        return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"),
                           F.when(low, F.col("n_a")).otherwise(F.col("n_b")).alias("n_a"),
                           F.when(low, F.col("n_b")).otherwise(F.col("n_a")).alias("n_b"))

    def _candidates(self, groups: DataFrame | None, name: str) -> DataFrame:
        """a, b, n_a, n_b: with the leaders while no groups are known, else from different groups; each once."""
        sets = self.sets.withColumn("group", F.col("key")) if groups is None else self.sets.join(
            groups, "key", "left").withColumn("group", F.coalesce("group", "key"))
        schema = "range int, body binary, shingle long, key long, `group` long, n long, pos long, own_share double"
        postings = write_out(sets.mapInArrow(tidy(_posting_task(self.tasks, HOT)), schema), self.folder, f"postings-{name}")
        packed = postings.where("range is not null").select("range", "body").groupBy("range").applyInArrow(
            tidy_group(_pair_task(self.num, self.den, groups is None)), "a long, b long, n_a long, n_b long")
        return packed.union(self._hot_pairs(postings.where("range is null"), groups is None)).distinct()

    def links(self) -> DataFrame:
        """The groups that verified links make: key, group."""
        tried = self._verified(self._candidates(None, "lead"), "lead")
        links = tried.where("linked").select("a", "b")
        groups = contract(links, self.folder, "lead-groups")
        more = self._candidates(groups, "open").join(tried.select("a", "b"), ["a", "b"], "left_anti")
        new = self._verified(more, "open").where("linked").select("a", "b")
        if new.isEmpty():
            return groups
        return contract(links.union(new), self.folder, "groups")

    def classes(self) -> DataFrame:
        """doc_id, n_shingles, component_id for every document."""
        by_key = self.docs.where("n_shingles > 0").groupBy("key").agg(F.min("doc_id").alias("low"))
        by_key = by_key.join(self.links(), "key", "left").withColumn("group", F.coalesce("group", "key"))
        lowest = by_key.groupBy("group").agg(F.min("low").alias("component_id"))
        by_key = by_key.join(lowest, "group")
        named = write_out(by_key.select("key", "component_id"), self.folder, "named")
        full = self.docs.where("n_shingles > 0").join(named, "key").select("doc_id", "n_shingles", "component_id")
        empty = self.docs.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
        return full.union(empty)


def duplicate_classes(docs: DataFrame, n: int = 5, similarity: str = "0.75") -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest doc_id that is reachable by links."""
    return Join(docs, n, similarity).classes()


def one_of_each(docs: DataFrame, n: int = 5, similarity: str = "0.75") -> DataFrame:
    """One document of each group: the row of least doc_id, null ones last; of rows that tie, the first written.
    Documents without shingles stay.

    Rows are told apart by a number written once, so neither a shared nor a missing doc_id decides.
    """
    folder = run_folder(docs.sparkSession, "one-of-each")
    keyed = write_out(docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("row")), folder, "docs")
    found = duplicate_classes(keyed.select(F.col("row").alias("doc_id"), F.col("doc.text").alias("text")), n, similarity)
    groups = write_out(found.select(F.col("doc_id").alias("row"), "component_id"), folder, "groups")
    ids = keyed.select("row", F.col("doc.doc_id").cast("long").alias("doc_id"))
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")
    stays = groups.join(ids, "row").groupBy("component_id").agg(F.min(order).alias("first")).select("first.row")
    gone = groups.select("row").join(stays, "row", "left_anti")
    return keyed.join(gone, "row", "left_anti").select("doc.*")
