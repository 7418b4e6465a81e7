import random

import brute
import corpus_pipeline
import numpy as np
import pytest

from plumbline.llm import near_copies

from corpus_fixtures import make_docs, odd_docs, rows, texts  # noqa: F401


def sets_of(texts):
    words = [t.lower().split() for t in texts]
    return [{tuple(w[j:j + 5]) for j in range(max(1, len(w) - 4))} if w else set() for w in words]


def wanted(rows):
    """Smallest id of each component of pairs of similarity 0.8 or more."""
    sets = sets_of([t for _, t in rows])
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), i), i)
    return sorted(least.values())


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def near_rows():
    """Copies with a word changed here and there: chains, pairs above and below the similarity, whole copies."""
    r = random.Random(7)
    out = []
    for k in range(12):
        words = [f"w{r.randrange(3000)}" for _ in range(r.choice([8, 60, 150, 400]))]
        for c in range(5):
            out.append((100 * c + k, " ".join(words)))
            words = list(words)
            for _ in range(r.randrange(len(words) // 35 + 2)):
                words[r.randrange(len(words))] = f"n{r.randrange(3000)}"
    return out


@pytest.mark.parametrize("limits", [{}, {"list_documents": 1}, {"list_documents": 2, "band_rows": 2, "sent_rows": 0}])
def test_near_copies_by_brute_force(make_docs, limits):
    docs = near_rows()
    assert ids(near_copies.distinct_documents(make_docs(docs).repartition(4), **limits)) == wanted(docs)


def test_stage_by_exact_similarity(make_docs, texts, spark, root):
    docs = [(i, t) for i, t, *_ in texts]
    out = ids(corpus_pipeline.near_dedup_stage(spark, make_docs(docs), root))
    assert out == wanted(docs)
    prints = [(i, brute.fingerprint(t)) for i, t in docs]
    assert out != sorted(set(brute.components(prints)))  # pairs of the similarity lie further apart than op4's four bits


def test_bands_find_pairs_of_the_similarity():
    r = np.random.default_rng(3)
    for _ in range(300):
        every = r.integers(0, 1 << 63, 100, np.uint64)
        (a, b), (x, y) = near_copies.bands([every[:90], every[10:]])  # 80 of 100 are shared
        assert (a == b).any() and (x == y).mean() >= near_copies.AGREEING


def test_odd_rows(odd_docs):
    out = near_copies.distinct_documents(odd_docs)
    assert out.dtypes == odd_docs.dtypes
    # texts without a word are one group, its smallest id 1; a row without an id stays if its text has no copy
    assert sorted((r.doc_id for r in out.collect()), key=str) == [1, 4, 6, 7, 8, None]
    assert near_copies.distinct_documents(odd_docs.filter("false")).count() == 0


def exact_pairs(rows, similarity=0.8):
    """All pairs of different sets of the similarity, by an exact prefix join: such a pair shares one of its rarest shingles."""
    sets = {}
    for i, t in rows:
        s = frozenset(near_copies.shingle_set((t or "").encode()).tolist())
        if s:
            sets.setdefault(s, i)
    sets = list(sets.items())
    count = {}
    for s, _ in sets:
        for x in s:
            count[x] = count.get(x, 0) + 1
    seen, out = {}, set()
    for k, (s, _) in enumerate(sets):
        rarest = sorted(s, key=lambda x: (count[x], x))[:len(s) - -(-4 * len(s) // 5) + 1]
        for other in {o for x in rarest for o in seen.get(x, ())}:
            both = len(s & sets[other][0])
            if both >= similarity * (len(s) + len(sets[other][0]) - both):
                out.add((sets[other][1], sets[k][1]))
        for x in rarest:
            seen.setdefault(x, []).append(k)
    return out


@pytest.mark.parametrize("scale", ["sf0.01"])
def test_no_pair_is_lost(spark, scale):
    """Recall of the proposals: every exact pair is among those that signatures leave to compare, and ends in one component."""
    from plumbline.llm.components import components
    from plumbline.session import cut_lineage

    docs = spark.read.parquet(f"/root/testdata/{scale}/documents.parquet")
    pairs = exact_pairs([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    each = docs.select(docs.doc_id.alias("node"), near_copies.sketch_column()("text").alias("s")).select("node", "s.*").filter("n > 0")
    each = cut_lineage(each, "each")
    root = {r.node: r.root for r in components(near_copies.candidates(each.dropDuplicates(["digest"]), cut_lineage)).collect()}
    first = {r.node: r.first for r in each.select("node", "digest").join(each.dropDuplicates(["digest"]).select("digest", each.node.alias("first")), "digest").collect()}
    lost = [p for p in pairs if root.get(first[p[0]], -1) != root.get(first[p[1]], -2)]
    assert pairs and not lost


def test_trees_propose_by_fingerprints(make_docs):
    from plumbline.llm.components import components
    from plumbline.session import cut_lineage
    from plumbline.llm.simhash import RADIUS
    docs = make_docs(near_rows())
    each = cut_lineage(docs.select(docs.doc_id.alias("node"), near_copies.sketch_column()("text").alias("s")).select("node", "s.*"), "each")
    prints = [(r.node, r.fp & (1 << 64) - 1) for r in each.collect()]
    root = {i: i for i, _ in prints}
    for _ in prints:
        for i, x in prints:
            root[i] = min(root[j] for j, y in prints if (x ^ y).bit_count() <= RADIUS)
    found = {r.node: r.root for r in components(near_copies.tree_candidates(each, cut_lineage)).collect()}
    assert len(found) > 20 and {i: found.get(i, i) for i in root} == root
