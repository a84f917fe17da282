"""Language identification by prediction by partial matching (PPM).

For each language a tree of byte contexts of order 0 to ``ORDER`` counts which byte follows which
context. A byte is coded in the longest context that is in the tree; a context that has not
seen it is left by an escape (method C: escape probability q / (n + q) for q kinds among n
bytes) for the next shorter one, down to equal chances for all 256 bytes. Statistics are frozen
after training, and contexts begin at white space (each word is preceded and followed by one
blank), so the exact code length of a text is the sum over its bytes, each with up to ``ORDER``
bytes before it. All counts stay in Spark tables; a worker holds the lengths of hot windows in all
languages, and those of a text's other windows come by a join. The language with the shortest code wins.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainweft.llm.text import held_out, sliced
from chainweft.session import materialise

ORDER = 4
#: Costs that every worker holds: of so many windows times languages; those of other windows are joined.
HOT_CELLS = 1_000_000
#: What a worker keeps: the first so many words up to a length, and windows of bytes.
CACHED_WORDS, CACHED_LENGTH, CACHED_WINDOWS = 150_000, 48, 400_000
UNKNOWN = "und"

_LETTER = regex.compile(r"\p{L}")


def _words(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").split()


def _windows(word: bytes) -> list[bytes]:
    """Each byte of a word and the blank after it, with up to ``ORDER`` bytes before it."""
    text = b" " + word + b" "
    return [text[max(0, end - ORDER) : end + 1] for end in range(1, len(text))]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, window, n) of a partition, by way of its distinct words."""
    seen: dict[str, Counter[bytes]] = defaultdict(Counter)

    def flushed() -> pa.RecordBatch:
        rows: list[tuple[str, bytes, int]] = []
        for lang, found in seen.items():
            own: Counter[bytes] = Counter()
            for word, n in found.items():
                for window in _windows(word):
                    own[window] += n
            rows += [(lang, w, n) for w, n in own.items()]
        seen.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.int64())], ["lang", "window", "n"]
        )

    for batch in sliced(batches):
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            seen[lang].update(_words(text or ""))
        if sum(map(len, seen.values())) > 300_000:
            yield flushed()
    yield flushed()


class Trees(list[str]):
    """Names of the languages learnt, in order, with tables of all their nodes and contexts."""

    nodes: DataFrame
    contexts: DataFrame
    #: The most frequent windows and their costs, a row for each window.
    hot: tuple[list[bytes], np.ndarray]


def train(documents: DataFrame) -> Trees:
    """The context trees of all languages, from every text with a language that is not held out.

    Counting runs over whole texts in Spark and every count stays there, as a table. A language
    without a word is not learnt. Only names and the costs of hot windows come to the driver.
    """
    learn = documents.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id"), 5, 0)).select(F.col("lang").cast("string").alias("lang"), "text")
    counted = learn.mapInArrow(_counted, "lang string, window binary, n long").groupBy("lang", "window").agg(F.sum("n").alias("n"))
    windows = materialise(counted, "windows")
    trees = Trees(sorted(r[0] for r in windows.select("lang").distinct().collect()))
    if not trees:
        return trees
    # a window counts for each context that ends before its last byte
    suffix = F.explode(F.expr("transform(sequence(1, octet_length(window)), k -> substring(window, octet_length(window) - k + 1, k))"))
    trees.nodes = materialise(windows.select("lang", suffix.alias("gram"), "n").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "nodes")
    before = F.expr("substring(gram, 1, octet_length(gram) - 1)").alias("context")
    trees.contexts = materialise(trees.nodes.groupBy("lang", before).agg(F.sum("n").alias("total"), F.count("*").alias("kinds")), "contexts")
    often = windows.groupBy("window").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "window").limit(max(1, HOT_CELLS // len(trees))).select("window")
    bits = F.sort_array(F.collect_list(F.struct("lang", "bits")))
    hot = costs(trees, often).groupBy("window").agg(bits.alias("all")).select("window", F.col("all.bits").alias("bits")).toArrow()
    trees.hot = hot.column("window").to_pylist(), hot.column("bits").combine_chunks().flatten().to_numpy().reshape(-1, len(trees))
    return trees


def costs(trees: Trees, windows: DataFrame) -> DataFrame:
    """``window``, ``lang`` and ``bits`` of the last byte of each of the distinct ``windows`` in each language."""
    parts = windows.select("window", F.explode(F.expr("sequence(1, octet_length(window))")).alias("k")).select(
        "window", "k", F.expr("substring(window, octet_length(window) - k + 1, k)").alias("gram"), F.expr("substring(window, octet_length(window) - k + 1, k - 1)").alias("context")
    )
    # contexts of one byte or none are in most windows, and at most 257 for each language
    known = parts.where("k <= 2").join(F.broadcast(trees.contexts.where("octet_length(context) <= 1")), "context")
    known = known.unionByName(parts.where("k > 2").join(trees.contexts, "context"))
    found = known.join(trees.nodes, ["lang", "gram"], "left").withColumn("whole", F.col("total") + F.col("kinds"))
    # a byte that a context has seen, all shorter ones have seen too
    code = F.max_by(F.log2(F.col("whole") / F.col("n")), F.when(F.col("n").isNotNull(), F.col("k")))
    escapes = [F.max(F.when((F.col("k") == k) & F.col("n").isNull(), F.log2(F.col("whole") / F.col("kinds")))) for k in range(1, ORDER + 2)]
    bits = sum((F.coalesce(e, F.lit(0.0)) for e in escapes), F.coalesce(code, F.lit(8.0)))
    return found.groupBy("window", "lang").agg(bits.alias("bits"))


class Coder:
    """Exact code lengths in bits under frozen trees that are at hand as a whole."""

    def __init__(self, trees: list[tuple[str, dict[bytes, int]]]) -> None:
        self.names = [name for name, _ in trees]
        self.counts = [tree for _, tree in trees]
        self.totals: list[dict[bytes, tuple[int, int]]] = []
        for tree in self.counts:
            totals: dict[bytes, tuple[int, int]] = {}
            for gram, n in tree.items():
                total, kinds = totals.get(gram[:-1], (0, 0))
                totals[gram[:-1]] = (total + n, kinds + 1)
            self.totals.append(totals)
        self.window: dict[bytes, int] = {}
        self.most = CACHED_WINDOWS
        self.costs = np.zeros((4096, len(self.names)))
        self.place: dict[bytes, int] = {}
        self.bits = np.zeros((4096, len(self.names)))

    def cost(self, window: bytes, language: int) -> float:
        """Bits of the last byte of a window after the bytes before it."""
        counts, totals, bits = self.counts[language], self.totals[language], 0.0
        for k in range(len(window)):
            context = window[k:-1]
            if context not in totals:
                continue
            total, kinds = totals[context]
            n = counts.get(window[k:])
            if n is not None:
                return bits - math.log2(n / (total + kinds))
            bits -= math.log2(kinds / (total + kinds))
        return bits + 8.0

    def _place(self, window: bytes) -> int | None:
        """Where the costs of a new window are kept."""
        k = len(self.window)
        if k >= len(self.costs):
            self.costs = np.concatenate([self.costs, np.zeros_like(self.costs)])
        self.costs[k] = [self.cost(window, j) for j in range(len(self.names))]
        self.window[window] = k
        return k

    def _known(self, windows: list[bytes], other: Counter[bytes]) -> list[int]:
        """Places of the windows' costs; windows without any are counted in ``other``."""
        out = []
        for w in windows:
            k = self.window.get(w)
            if k is None:
                k = self._place(w)
            if k is None:
                other[w] += 1
            else:
                out.append(k)
        return out

    def coded(self, text: str) -> tuple[np.ndarray, Counter[bytes]]:
        """Bits of a whole text in every language, without those of the windows that are counted beside them."""
        if len(self.window) > self.most:
            self.window.clear()
        at, rest, other = [], [], Counter()
        for word in _words(text):
            k = self.place.get(word)
            if k is not None:
                at.append(k)
            elif len(word) <= CACHED_LENGTH:
                missing: Counter[bytes] = Counter()
                windows = self._known(_windows(word), missing)
                if missing or len(self.place) >= CACHED_WORDS:
                    rest += windows
                    other.update(missing)
                    continue
                k = len(self.place)
                if k >= len(self.bits):
                    self.bits = np.concatenate([self.bits, np.zeros_like(self.bits)])
                self.bits[k] = self.costs[windows].sum(axis=0)
                self.place[word] = k
                at.append(k)
            else:
                for start in range(0, len(word) + 1, 4096):  # a long word, in parts with the bytes before
                    part = (b" " + word + b" ")[max(0, start + 1 - ORDER) : start + 4097]
                    first = min(start + 1, ORDER)
                    rest += self._known([part[max(0, end - ORDER) : end + 1] for end in range(first, len(part))], other)
        return self.bits[np.array(at, np.int64)].sum(axis=0) + self.costs[np.array(rest, np.int64)].sum(axis=0), other

    def lengths(self, text: str) -> np.ndarray:
        """Bits of a whole text in every language."""
        return self.coded(text)[0]

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language and score of a text, see :func:`identified`."""
        return _verdict(self.names, self.lengths(text) if self.names and text and _LETTER.search(text) else None)


class HotCoder(Coder):
    """Code lengths from the costs of hot windows; other windows are left to a join."""

    def __init__(self, names: list[str], windows: list[bytes], bits: np.ndarray) -> None:
        super().__init__([(name, {}) for name in names])
        self.window, self.costs, self.most = {w: k for k, w in enumerate(windows)}, bits, len(windows)

    def _place(self, window: bytes) -> int | None:
        return None


def _verdict(names: list[str], bits: np.ndarray | None) -> tuple[str, float]:
    if bits is None:
        return UNKNOWN, 0.0
    best = int(bits.argmin())
    return names[best], float(1 / np.exp2(np.maximum(bits[best] - bits, -1000)).sum())


_CODERS: dict[int, HotCoder] = {}


def _coder(shared) -> HotCoder:  # noqa: ANN001
    if id(shared.value) not in _CODERS:
        _CODERS.clear()
        _CODERS[id(shared.value)] = HotCoder(*shared.value)
    return _CODERS[id(shared.value)]


def identified(documents: DataFrame, trees: Trees, prefix: str = "lang_", keep: list[str] | None = None) -> DataFrame:
    """``documents`` with ``<prefix>pred`` and ``<prefix>score`` for each whole text.

    The language with the shortest code and its posterior among all, by code lengths. Without a
    letter (or a null text, or nothing learnt) the language is ``und`` and the score 0. Equal
    lengths go to the first name. Columns that already have these names are replaced, others stay
    as they are; ``keep`` names those to keep, all by default.

    A worker codes hot windows itself; each text's other distinct windows are joined to the tables.
    """
    keep, names = documents.columns if keep is None else keep, list(trees)
    pred, score = f"{prefix}pred", f"{prefix}score"
    if not names:
        return documents.select(*keep).withColumns({pred: F.lit(UNKNOWN), score: F.lit(0.0)})
    shared = documents.sparkSession.sparkContext.broadcast((names, *trees.hot))  # HOT_CELLS costs at most, or one window

    @F.pandas_udf("bits array<double>, window array<binary>, n array<long>")
    def code(texts):  # noqa: ANN001, ANN202
        import pandas as pd

        coder, out = _coder(shared), []
        for text in texts:
            bits, other = coder.coded(text) if text and _LETTER.search(text) else (None, {})
            out.append((bits, list(other), list(other.values())))
        return pd.DataFrame(out, columns=["bits", "window", "n"])

    @F.pandas_udf("pred string, score double")
    def verdict(bits, more):  # noqa: ANN001, ANN202
        import pandas as pd

        whole = (None if b is None else b if m is None else b + m for b, m in zip(bits, more, strict=True))
        return pd.DataFrame([_verdict(names, b) for b in whole], columns=["pred", "score"])

    rows = materialise(documents.select(*keep, F.monotonically_increasing_id().alias("__row__"), code("text").alias("__code__")), "codes")
    other = rows.select("__row__", F.explode(F.arrays_zip(F.col("__code__.window").alias("window"), F.col("__code__.n").alias("n"))).alias("other")).select("__row__", "other.*")
    bits = F.sum((F.col("bits") * F.col("n")).cast("decimal(28,12)"))  # the same in any order
    more = (
        other.join(costs(trees, other.select("window").distinct()), "window").groupBy("__row__", "lang").agg(bits.cast("double").alias("bits"))
        .groupBy("__row__").agg(F.sort_array(F.collect_list(F.struct("lang", "bits"))).alias("all")).select("__row__", F.col("all.bits").alias("__more__"))
    )
    found = rows.join(more, "__row__", "left").withColumn("__lang__", verdict("__code__.bits", "__more__"))
    return found.withColumns({pred: F.col("__lang__.pred"), score: F.col("__lang__.score")}).drop("__row__", "__code__", "__more__", "__lang__")
