"""Secret scanning: candidates by pattern, false positives removed by a random forest.

All of it is DataFrame operations: candidates and their features are built-in functions, the
forest is grown level by level from aggregated histograms, and a grown tree is a CASE expression.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.llm.common import picked
from plumbline.session import cut_lineage

#: Runs of at least 16 characters of keys and tokens, from one end to the other.
CANDIDATE = r"(?<![A-Za-z0-9_+/=.-])[A-Za-z0-9_+/=.-]{16,}+"
BEFORE, AFTER = 48, 24
TREES, DEPTH, BINS = 9, 4, 16
#: About how many labelled findings of each label the forest learns from.
SAMPLE = 20_000
#: Words of the corpus's dictionary: the most frequent ones by documents, of at least so many letters.
DICTIONARY_WORDS, WORD_LETTERS = 400, 3

# Names that stand before a secret.
NAMES = "token|secret|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key|private[_-]?key|auth|bearer|credential"
# Lengths in hexadecimal digits of the digests that keys and tokens are made of.
DIGEST_DIGITS = (32, 40, 48, 64, 96, 128)

FEATURES = (
    "n_chars", "n_runs", "run_share", "digit_share", "upper_share", "vowel_share", "alternations",
    "word_share", "n_slashes", "n_dots", "in_url", "named", "assigned", "quoted", "distinct_share")


def candidates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, first, end, value, before, after): every run of candidate characters in the whole text.

    Splitting at the same pattern gives what lies between the runs, and so their places in code
    points and their neighbours. Null and empty texts have none; repeated rows each give theirs.
    """
    rows = picked(docs, doc_id=doc_id, text=text).filter(F.col("text").rlike(CANDIDATE))
    found = rows.withColumn("row", F.monotonically_increasing_id()).select(
        "row", "doc_id", F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)).alias("values"), F.split("text", CANDIDATE, -1).alias("gaps"))
    each = found.select("row", "doc_id", "gaps", F.posexplode("values").alias("k", "value"))
    each = each.select(
        "row", "doc_id", "k", "value", F.char_length(F.get("gaps", F.col("k"))).alias("gap"),
        F.right(F.get("gaps", F.col("k")), F.lit(BEFORE)).alias("before"), F.left(F.get("gaps", F.col("k") + 1), F.lit(AFTER)).alias("after"))
    # the runs of one text, in order: as many as the text has room for
    so_far = W.partitionBy("row").orderBy("k").rowsBetween(W.unboundedPreceding, W.currentRow)
    end = F.sum(F.col("gap") + F.char_length("value")).over(so_far)
    return each.withColumn("end", end).select("doc_id", (F.col("end") - F.char_length("value")).alias("first"), "end", "value", "before", "after")


def dictionary(docs: DataFrame, text: str = "text", words: int = DICTIONARY_WORDS) -> list[str]:
    """The ``words`` most frequent words of all texts, by the number of rows that have them; ties by the word itself."""
    every = F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+"))
    counted = picked(docs, text=text).filter("text is not null").select(F.explode(every).alias("word")).filter(F.char_length("word") >= WORD_LETTERS).groupBy("word").count()
    return sorted(r.word for r in counted.orderBy(F.desc("count"), "word").limit(words).collect())


def featured(found: DataFrame, known: list[str]) -> DataFrame:
    """``found`` with the columns of ``FEATURES`` as doubles: length, transitions, coverage by the words ``known``, path, neighbours."""
    v = F.col("value")
    n = F.char_length(v)
    share = lambda chars: F.char_length(F.regexp_replace(v, f"[^{chars}]", "")) / n
    # each character as its class, and each run of a class as one letter
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(v, "[a-z]", "a"), "[A-Z]", "A"), "[0-9]", "9"), "[^aA9]", "-")
    runs = F.regexp_replace(classes, r"(.)\1*+", "$1")
    words = F.regexp_replace(F.lower(v), "|".join(sorted(known, key=lambda w: (-len(w), w))) or "(?!)", "")
    letters = F.regexp_replace(F.lower(v), "[^a-z0-9]", "")
    yes = lambda c: c.cast("double")
    values = {
        "n_chars": n, "n_runs": F.char_length(runs), "run_share": F.char_length(runs) / n, "digit_share": share("0-9"),
        "upper_share": share("A-Z"), "vowel_share": share("aeiouAEIOU"),
        "alternations": F.char_length(F.regexp_replace(runs, "[^a9A]", "")) / n,
        "word_share": 1 - F.char_length(words) / n, "n_slashes": n - F.char_length(F.regexp_replace(v, "/", "")),
        "n_dots": n - F.char_length(F.regexp_replace(v, "[.]", "")),
        "in_url": yes(F.col("before").rlike(r"(?i)(://|www[.]|[\\/@?&#%])[^\s]*$")),
        "named": yes(F.col("before").rlike(rf"(?i)(?:{NAMES})[^\n]{{0,12}}$")), "assigned": yes(F.col("before").rlike(r"(?:=|:)\s*[\"'`]?$")),
        "quoted": yes(F.col("before").rlike("[\"'`]$") & F.col("after").rlike("^[\"'`]")),
        "distinct_share": F.size(F.array_distinct(F.split(letters, ""))) / n,
    }
    return found.withColumns({k: c.cast("double") for k, c in values.items()})


@dataclass
class Node:
    """A split (feature, threshold, low, high), or a leaf with the share of secrets."""

    share: float
    feature: str | None = None
    threshold: float = 0.0
    low: Node | None = None
    high: Node | None = None


def _complete(tree: Node, depth: int) -> tuple[list[int], list[float], list[float]]:
    """A tree as arrays of a complete one: feature number, threshold and share by place, the children of k at 2k + 1 and 2k + 2.

    Below a leaf all goes to the low child, which has its share.
    """
    size = (1 << (depth + 1)) - 1
    feature, threshold, share = [1] * size, [float("inf")] * size, [0.0] * size

    def put(node: Node, k: int) -> None:
        share[k] = node.share
        if node.feature is not None:
            feature[k], threshold[k] = FEATURES.index(node.feature) + 1, node.threshold
            put(node.low, 2 * k + 1)
            put(node.high, 2 * k + 2)
        elif 2 * k + 2 < size:
            put(node, 2 * k + 1)

    put(tree, 0)
    return feature, threshold, share


def _place(tree: Node, depth: int) -> Column:
    """The place in the complete tree where a row ends: a walk over arrays, so the expression stays small however the tree looks."""
    feature, threshold, _ = _complete(tree, depth)
    features, thresholds = F.array(*map(F.lit, feature)), F.array(*map(F.lit, threshold))
    values = F.array(*map(F.col, FEATURES))
    return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(0), lambda k, _: F.when(
        F.element_at(values, F.element_at(features, k + 1)) <= F.element_at(thresholds, k + 1), 2 * k + 1).otherwise(2 * k + 2)) if depth else F.lit(0)


def _depth(tree: Node) -> int:
    return 0 if tree.feature is None else 1 + max(_depth(tree.low), _depth(tree.high))


@dataclass
class Forest:
    trees: list[Node] = field(default_factory=list)

    def probability(self) -> Column:
        """Mean of the trees' leaves; 1 for an empty forest, so that nothing is removed."""
        if not self.trees:
            return F.lit(1.0)
        total = F.lit(0.0)
        for tree in self.trees:
            depth = _depth(tree)
            total = total + F.element_at(F.array(*map(F.lit, _complete(tree, depth)[2])), _place(tree, depth) + 1)
        return total / len(self.trees)


def _leaf_number(tree: Node) -> tuple[Column, dict[int, Node]]:
    """The place of a row's leaf, and the leaves by place."""
    depth, leaves = _depth(tree), {}

    def walk(node: Node, k: int, level: int) -> None:
        if node.feature is not None:
            walk(node.low, 2 * k + 1, level + 1)
            walk(node.high, 2 * k + 2, level + 1)
        elif level < depth:
            walk(node, 2 * k + 1, level + 1)
        else:
            leaves[k] = node

    walk(tree, 0, 0)
    return _place(tree, depth), leaves


def _gini_gain(w0: float, y0: float, w: float, y: float) -> float:
    """Fall of impurity when weight w0 with y0 secrets is split off weight w with y."""
    w1, y1 = w - w0, y - y0
    if min(w0, w1) < 5:
        return 0.0
    return y0 * y0 / w0 + y1 * y1 / w1 - y * y / w + (w0 - y0) ** 2 / w0 + (w1 - y1) ** 2 / w1 - (w - y) ** 2 / w


def train(labelled: DataFrame, label: str = "label", trees: int = TREES, depth: int = DEPTH, bins: int = BINS, sample: int = SAMPLE) -> Forest:
    """A forest from labelled findings with features (label: 0 or 1; null labels teach nothing).

    Learns from about ``sample`` findings of each label, those with the smallest hashes; no label's findings meet
    in one task. For each level one aggregation counts weight and secrets by tree, leaf, feature and bin; only these
    histograms, of a size fixed by the parameters, come to the driver. A row's weight in a tree is 0, 1 or 2
    by hash (a bootstrap), and each leaf looks at about a third of the features, also by hash.
    Equal rows weigh as one each. Fewer than two labels give an empty forest.
    """
    rows = labelled.filter(F.col(label).isNotNull()).select(F.xxhash64("doc_id", "first", "value").alias("h"), F.col(label).cast("double").alias("label"), *FEATURES)
    rows = cut_lineage(rows, "features")
    place = (F.shiftrightunsigned("h", 11)).cast("double") / float(1 << 53)
    counts = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    share = F.lit(0.0)
    for value, n in counts.items():
        share = F.when(F.col("label") == value, sample / n).otherwise(share)
    rows = cut_lineage(rows.filter(place < share), "labelled")
    if rows.select("label").distinct().count() < 2:
        return Forest()
    steps = [(i + 1) / bins for i in range(bins - 1)]
    cuts = rows.agg(*[F.percentile_approx(f, steps, 10_000).alias(f) for f in FEATURES]).first().asDict()
    cuts = {f: sorted(set(c or ())) for f, c in cuts.items()}
    grown = [Node(0.5) for _ in range(trees)]
    for level in range(depth + 1):
        numbered = [_leaf_number(t) for t in grown]
        per_tree = F.array(*[F.struct(
            F.lit(t).alias("tree"), number.alias("leaf"),
            F.element_at(F.array(*map(F.lit, (0.0, 1.0, 1.0, 2.0))), (F.pmod(F.xxhash64("h", F.lit(t)), F.lit(4)) + 1).cast("int")).alias("weight"))
            for t, (number, _) in enumerate(numbered)])
        # a feature's bin: the number of cuts below the value
        binned = F.array(*[F.struct(F.lit(i).alias("feature"), sum(((F.col(f) > c).cast("int") for c in cuts[f]), F.lit(0)).alias("bin")) for i, f in enumerate(FEATURES)])
        counts = (rows.select("label", binned.alias("binned"), F.explode(per_tree).alias("t")).filter("t.weight > 0")
                  .select("label", "t.*", F.explode("binned").alias("b")).groupBy("tree", "leaf", "b.feature", "b.bin")
                  .agg(F.sum("weight").alias("w"), F.sum(F.col("weight") * F.col("label")).alias("y")).collect())
        table: dict[tuple[int, int, int], dict[int, tuple[float, float]]] = {}
        for r in counts:
            table.setdefault((r.tree, r.leaf, r.feature), {})[r.bin] = (r.w, r.y)
        for t, (_, leaves) in enumerate(numbered):
            for k, leaf in leaves.items():
                _grow(leaf, {i: table.get((t, k, i), {}) for i in range(len(FEATURES))}, cuts, (t, level, k), level < depth)
    return Forest(grown)


def _grow(leaf: Node, hists: dict[int, dict[int, tuple[float, float]]], cuts: dict[str, list[float]], place: tuple[int, int, int], split: bool) -> None:
    """Set the share of a leaf, and split it at the best of its features' cuts if that helps."""
    w, y = (sum(x[j] for x in hists[0].values()) for j in (0, 1))
    leaf.share = (y + 0.5) / (w + 1)
    best = (1e-9, None, 0.0)
    t, level, k = place
    for i, f in enumerate(FEATURES):
        if not split or zlib.crc32(f"{t} {level} {k} {f}".encode()) % 3:
            continue
        w0 = y0 = 0.0
        for b, cut in enumerate(cuts[f]):
            own = hists[i].get(b, (0.0, 0.0))
            w0, y0 = w0 + own[0], y0 + own[1]
            gain = _gini_gain(w0, y0, w, y)
            if gain > best[0]:
                best = (gain, f, cut)
    if best[1] is not None:
        leaf.feature, leaf.threshold, leaf.low, leaf.high = best[1], best[2], Node(leaf.share), Node(leaf.share)


def labels(found: DataFrame) -> DataFrame:
    """``found`` with ``label``, from what the forest doesn't see: checksums, digest lengths and how many documents have the value.

    1: as long as a digest, hexadecimal of one case, and not a decimal number. 0: digits with a right check digit (Luhn), or
    a value without such a form in at least two documents, as words, addresses and file names are. Null where neither says
    anything: these findings are judged by the forest alone.
    """
    v = F.col("value")
    digits = F.transform(F.split(F.reverse(v), ""), lambda d: d.try_cast("int"))
    doubled = F.transform(digits, lambda d, k: F.when(k % 2 == 0, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0)))
    luhn = v.rlike("^[0-9]+$") & (F.aggregate(doubled, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0)
    digest = (v.rlike("^[0-9a-f]+$") | v.rlike("^[0-9A-F]+$")) & ~v.rlike("^[0-9]+$") & F.char_length(v).isin(*DIGEST_DIGITS)
    spread = found.groupBy(F.col("value").alias("known")).agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).filter("a <> b").select("known")
    common = cut_lineage(spread, "common")  # one row a value, so a frequent one is split in the join like any other
    marked = found.join(common, F.col("value") == F.col("known"), "left")
    return marked.withColumn("label", F.when(digest, 1).when(luhn | F.col("known").isNotNull(), 0)).drop("known")


def scored(found: DataFrame, forest: Forest, known: list[str], threshold: float = 0.5) -> DataFrame:
    """``found`` with ``probability`` and ``is_secret``."""
    out = featured(found, known).withColumn("probability", forest.probability()).drop(*FEATURES)
    return out.withColumn("is_secret", F.col("probability") >= threshold)


def quality(judged: DataFrame) -> tuple[float, float]:
    """Precision and recall over the findings of ``scored`` that have a label; 1 where there is nothing to divide by."""
    r = judged.agg(*[F.count_if(c).alias(k) for k, c in {
        "hit": F.col("is_secret") & (F.col("label") == 1), "said": F.col("is_secret") & F.col("label").isNotNull(), "real": F.col("label") == 1}.items()]).first()
    return (r.hit / r.said if r.said else 1.0), (r.hit / r.real if r.real else 1.0)


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", learn: Column | None = None, threshold: float = 0.5, labelled: DataFrame | None = None) -> DataFrame:
    """doc_id, first, end, label, probability, is_secret: one row for each candidate in ``docs``.

    Candidates are found once and written. The forest learns from those with a label in the rows that ``learn`` (an
    expression over doc_id) names, all by default, or from ``labelled`` (findings as from ``candidates``, with a label).
    Null and empty texts have no candidates, repeated rows each have theirs, null ids learn like others if ``learn`` is
    true for them; an empty table gives no rows; other columns don't matter.
    """
    known = dictionary(docs, text)
    found = cut_lineage(labels(cut_lineage(candidates(docs, doc_id, text), "candidates")), "findings")
    own = found if learn is None else found.filter(learn)
    forest = train(featured(own if labelled is None else labelled, known))
    return scored(found, forest, known, threshold).select("doc_id", "first", "end", "label", "probability", "is_secret")
