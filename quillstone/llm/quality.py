"""Quality by an interpolated modified Kneser-Ney model of trusted text.

The model has two layers, both of n-grams. The lower is over the characters of a
word, with begin and end marks, so that it needs no word list. The upper is over
the words of a text in their order, each seen as its class: the case and kind of its
characters, the punctuation that ends it, its length, and whether it repeats one of
the two words before it. (N-grams of the words themselves are nearly all distinct,
and would move more than the text.) A word costs what both layers say.

N-grams of the trusted texts are counted per task, summed by gram, and lower orders
count distinct left neighbours. To score, documents are dealt into chunks of bounded
size; a chunk asks for its distinct grams, those are joined order by order with the
count tables, which are sharded by gram, and the answers go back to the chunk, where
words and documents add up their costs. Costs are whole multiples of 2**-16 bits, so
sums don't depend on their order.

One trusted document of ``HELD_OUT``, by a hash of its id, is left out of the counts, and
these set the limits: the mean bits a symbol in their language, and that language's
``quantile`` of how far they exceed the mean. Excess is the sum of bits above the mean
over the root of the symbols, whose spread does not depend on a text's length. A
language with fewer than ``LEAST_HELD`` such documents takes the mean and quantile of all
of them.

Cases: a text without words (null, empty, white space) has no perplexity and is
accepted; without any held-out trusted text all is accepted; a null language is one
of its own; a very long text is one document of its chunk and read whole; repeated
ids are scored row by row; an empty table gives no rows; extra columns are ignored by
``score`` and kept by ``accepted``, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstone.llm.common import durable, map_arrow, quoted, release_memory, scratch, ship, sized_broadcast, slices, texts_of, without

ORDER = 4
BEGIN, END = "\x02", "\x03"
SCALE = 1 << 16
#: Text that a chunk holds, and the least worth a chunk of its own.
CHUNK_BYTES, LEAST_BYTES = 16 << 20, 1 << 20
QUANTILE, HELD_OUT = 0.997, 2
#: Held-out documents that a language needs for a limit of its own.
LEAST_HELD = 20
#: Thousandths of excess in a band of the histogram.
BAND = 500
#: The classes of words are single characters from this one on.
CLASSES = 0xE000
#: Text that is split into words at once, and forms that are cut into grams at once.
SLICE_BYTES, FORMS = 1 << 20, 65_536
#: Grams that a task holds before it sends partial counts on.
HELD_GRAMS = 1_000_000


def grams(word: str, order: int = ORDER) -> list[str]:
    """The gram that ends at each symbol of the word and at its end mark."""
    padded = BEGIN * (order - 1) + word + END
    return [padded[i : i + order] for i in range(len(word) + 1)]


def word_class(word: str) -> int:
    """Case and kind, final punctuation, and length; even, as one more marks a repeat."""
    core = word.rstrip(".,;:!?\"')]")
    if core.isalpha():
        kind = 0 if core.islower() else 1 if core[1:].islower() or len(core) == 1 else 2 if core.isupper() else 3
    else:
        kind = 4 if core.isdigit() else 5 if any(map(str.isalnum, core)) else 6
    last = word[len(core) :][-1:]
    end = 0 if not last else 1 if last in ".!?" else 2
    return 2 * ((kind * 3 + end) * 3 + (0 if len(word) < 4 else 1 if len(word) < 9 else 2))


def _starts(ends: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.int64), ends])[:-1]


class Lexicon(dict):
    """Numbers of the word forms of a task, given as they appear."""

    def __init__(self) -> None:
        super().__init__()
        self.forms: list[str] = []
        self.classes = np.zeros(0, np.int64)

    def __missing__(self, form: str) -> int:
        self[form] = number = len(self.forms)
        self.forms.append(form)
        return number

    def read(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The texts' words as numbers, one after another, and where each text ends."""
        words: list[str] = []
        ends = []
        for text in texts:
            if text:
                words += text.split()
            ends.append(len(words))
        numbers = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        new = [word_class(f) for f in self.forms[len(self.classes) :]]
        self.classes = np.concatenate([self.classes, np.array(new, np.int64)])
        return numbers, np.array(ends, np.int64)


def symbol_grams(symbols: np.ndarray, ends: np.ndarray, bits: int, order: int, begin: int) -> np.ndarray:
    """The gram that ends at each symbol of sequences laid end to end, as a number of
    ``bits`` a symbol; symbols before a sequence are ``begin``."""
    starts = _starts(ends)
    place = np.arange(len(symbols)) - np.repeat(starts, np.diff(np.concatenate([[0], ends])))
    out = symbols.astype(np.uint64)
    for k in range(1, order):
        before = np.full(len(symbols), begin, np.uint64)
        inside = np.flatnonzero(place >= k)
        before[inside] = symbols[inside - k]
        out |= before << np.uint64(bits * k)
    return out


def gram_texts(codes: np.ndarray, points: np.ndarray, bits: int, order: int) -> list[str]:
    """Numbers of ``symbol_grams`` as strings of the symbols' code points."""
    mask = np.uint64((1 << bits) - 1)
    columns = [points[((codes >> np.uint64(bits * k)) & mask).astype(np.int64)] for k in range(order - 1, -1, -1)]
    text = np.ascontiguousarray(np.stack(columns, axis=1), dtype="<u4").tobytes().decode("utf-32-le")
    return [text[i : i + order] for i in range(0, len(text), order)]


def pieces(n: int) -> Iterator[slice]:
    """Stretches of n forms whose grams are held at once."""
    return (slice(i, i + FORMS) for i in range(0, n, FORMS))


def form_grams(forms: list[str], order: int = ORDER) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct grams of word forms, the gram that ends at each symbol of the forms one
    after another (as its place among these), and where each form ends."""
    ends = np.cumsum(np.array([len(f) + 1 for f in forms], np.int64))
    points, dense = np.unique(np.frombuffer("".join(forms).encode("utf-32-le"), "<u4"), return_inverse=True)
    bits = (len(points) + 1).bit_length()
    if bits * order > 64:  # more characters than numbers can tell apart
        places: dict[str, int] = {}
        at = np.array([places.setdefault(g, len(places)) for f in forms for g in grams(f, order)], np.int64)
        return list(places), at, ends
    symbols = np.ones(ends[-1] if len(ends) else 0, np.int64)  # 0 begins, 1 ends a word
    inside = np.ones(len(symbols), bool)
    inside[ends - 1] = False
    symbols[inside] = dense + 2
    codes, at = np.unique(symbol_grams(symbols, ends, bits, order, 0), return_inverse=True)
    return gram_texts(codes, np.concatenate([np.array([ord(BEGIN), ord(END)], "<u4"), points]), bits, order), at, ends


#: Numbers of classes, and what stands before a text's first word.
CLASS_BITS, CLASS_BEGIN = 7, 127


def class_codes(lexicon: Lexicon, numbers: np.ndarray, ends: np.ndarray, order: int = ORDER) -> np.ndarray:
    """The gram of classes that ends at each word."""
    classes = lexicon.classes[numbers]
    starts = np.repeat(_starts(ends), np.diff(np.concatenate([[0], ends])))
    place = np.arange(len(numbers)) - starts
    again = np.zeros(len(numbers), bool)
    for k in (1, 2):
        again[k:] |= (numbers[k:] == numbers[:-k]) & (place[k:] >= k)
    return symbol_grams(classes + again, ends, CLASS_BITS, order, CLASS_BEGIN)


def class_texts(codes: np.ndarray, order: int = ORDER) -> list[str]:
    points = np.arange(CLASSES, CLASSES + CLASS_BEGIN + 1, dtype="<u4")
    points[CLASS_BEGIN] = ord(BEGIN)
    return gram_texts(codes, points, CLASS_BITS, order)


def sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of stretches that end at ``ends``; an empty one is 0."""
    upto = np.concatenate([[0], np.cumsum(values)])
    return upto[ends] - upto[_starts(ends)]


def count_grams(docs: DataFrame, text_col: str = "text", order: int = ORDER) -> DataFrame:
    """layer (0 characters, 1 classes), gram and c: occurrences in all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[Counter[str], Counter[int]] = Counter(), Counter()
        lexicon, seen = Lexicon(), np.zeros(0, np.int64)

        def fold() -> None:
            nonlocal lexicon, seen
            for some in pieces(len(lexicon.forms)):
                texts, at, ends = form_grams(lexicon.forms[some], order)
                own = np.bincount(at, weights=np.repeat(seen[some], np.diff(np.concatenate([[0], ends]))), minlength=len(texts))
                held[0].update(dict(zip(texts, own.astype(np.int64).tolist(), strict=True)))
            lexicon, seen = Lexicon(), np.zeros(0, np.int64)

        def partial() -> Iterator[pa.RecordBatch]:
            codes = np.array(list(held[1]), np.uint64)
            for layer, names, counts in ((0, list(held[0]), list(held[0].values())), (1, class_texts(codes, order) if len(codes) else [], list(held[1].values()))):
                if names:
                    yield pa.record_batch([pa.array([layer] * len(names), pa.int8()), pa.array(names, pa.string()), pa.array(counts, pa.int64())], ["layer", "gram", "n"])
                held[layer].clear()

        for b in batches:
            for part in slices(b, "text", max_bytes=SLICE_BYTES):
                numbers, ends = lexicon.read(part.column("text").to_pylist())
                own = np.bincount(numbers, minlength=len(lexicon.forms))
                own[: len(seen)] += seen
                seen = own
                codes, n = np.unique(class_codes(lexicon, numbers, ends, order), return_counts=True)
                held[1].update(dict(zip(codes.tolist(), n.tolist(), strict=True)))
                if len(lexicon) > HELD_GRAMS // 4:
                    fold()
                if len(held[0]) + len(held[1]) > HELD_GRAMS:
                    yield from partial()
        fold()
        yield from partial()

    counts = map_arrow(docs.select(quoted(text_col).alias("text")), run, "layer byte, gram string, n long")
    return counts.groupBy("layer", "gram").agg(F.sum("n").alias("c"))


class KneserNey:
    """Count tables of each order, with discounts and context weights."""

    def __init__(self, top: DataFrame, order: int = ORDER):
        self.order = order
        self.counts: dict[int, DataFrame] = {order: durable(top, "grams")}
        for k in range(order - 1, 0, -1):
            shorter = self.counts[k + 1].groupBy(F.substring("gram", 2, k).alias("gram")).agg(F.count("*").alias("c"))
            self.counts[k] = durable(shorter, "grams")
        self.discounts = {k: self._discounts(t) for k, t in self.counts.items()}
        self.contexts = {k: self._contexts(k) for k in range(2, order + 1)}
        kinds, total = self.counts[1].agg(F.count("*"), F.coalesce(F.sum("c"), F.lit(0))).first()
        self.symbols, self.total = kinds + 1, total  # one more for any unseen symbol

    @staticmethod
    def _discounts(table: DataFrame) -> tuple[float, float, float]:
        n1, n2, n3, n4 = (x or 0 for x in table.agg(*(F.sum(F.when(F.col("c") == i, 1)) for i in range(1, 5))).first())
        if not (n1 and n2 and n3):
            return 0.5, 1.0, 1.5
        y = n1 / (n1 + 2 * n2)
        found = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3
        return tuple(min(max(d, 0.05), float(i)) for i, d in enumerate(found, 1))

    def _discount(self, k: int, c: Column) -> Column:
        d1, d2, d3 = self.discounts[k]
        return F.when(c == 1, d1).when(c == 2, d2).otherwise(d3)

    def _contexts(self, k: int) -> DataFrame:
        """context, total, weight: what the lower order gets after a context."""
        c = F.col("c")
        weight = F.sum(self._discount(k, c)) / F.sum(c)
        return durable(self.counts[k].groupBy(F.substring("gram", 1, k - 1).alias("context")).agg(F.sum(c).alias("total"), weight.alias("weight")), "contexts")

    def costs(self, asked: DataFrame) -> DataFrame:
        """gram and cost, in 2**-16 bits, of the distinct grams of ``asked``."""
        found, n = asked.select("gram"), self.order
        for k in range(n, 0, -1):
            own = F.substring("gram", n - k + 1, k)
            table = self.counts[k].select(F.col("gram").alias("__g"), F.col("c").alias(f"c{k}"))
            found = found.withColumn("__g", own).join(table, "__g", "left").drop("__g")
            if k > 1:
                table = self.contexts[k].select(F.col("context").alias("__g"), F.col("total").alias(f"t{k}"), F.col("weight").alias(f"w{k}"))
                found = found.withColumn("__g", F.substring("gram", n - k + 1, k - 1)).join(table, "__g", "left").drop("__g")
        c = F.coalesce("c1", F.lit(0))
        p = F.lit(1.0 / self.symbols)
        if self.total:
            p = F.when(c > 0, (c - self._discount(1, c)) / self.total).otherwise(0.0) + self._unigram_weight() / self.symbols
        for k in range(2, n + 1):
            c = F.coalesce(f"c{k}", F.lit(0))
            seen = F.when(c > 0, (c - self._discount(k, c)) / F.col(f"t{k}")).otherwise(0.0)
            p = F.when(F.col(f"t{k}").isNull(), p).otherwise(seen + F.col(f"w{k}") * p)
        return found.select("gram", F.round(-F.log2(p) * SCALE).cast("long").alias("cost"))

    def _unigram_weight(self) -> float:
        return self.counts[1].agg(F.sum(self._discount(1, F.col("c")))).first()[0] / self.total


class Layers:
    """The model of characters and that of classes."""

    def __init__(self, counts: DataFrame, order: int = ORDER):
        self.order = order
        counts = durable(counts, "layers")
        self.models = [KneserNey(counts.where(F.col("layer") == layer).select("gram", "c"), order) for layer in (0, 1)]

    def costs(self, asked: DataFrame) -> DataFrame:
        """layer, gram, cost of the distinct layer and gram of ``asked``."""
        layers = [m.costs(asked.where(F.col("layer") == i)).withColumn("layer", F.lit(i).cast("byte")) for i, m in enumerate(self.models)]
        return layers[0].unionByName(layers[1])


def score(docs: DataFrame, model: Layers, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """id, lang, symbols, cost: the document's symbols and their cost."""
    ship(docs.sparkSession)
    order = model.order
    rows = docs.select(quoted(id_col).alias("id"), quoted(lang_col).cast("string").alias("lang"), quoted(text_col).alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = max(1, -(-size // CHUNK_BYTES), min(tasks, size // LEAST_BYTES))
    key = F.when(F.col("id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("id"))
    dealt = rows.withColumn("chunk", F.pmod(key, F.lit(chunks)).cast("int")).repartition(chunks, "chunk").sortWithinPartitions("chunk")  # one chunk after another

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, lexicon, classes = -1, Lexicon(), np.zeros(0, np.uint64)

        def asked() -> Iterator[pa.RecordBatch]:
            lower: dict[str, None] = {}
            for some in pieces(len(lexicon.forms)):
                lower |= dict.fromkeys(form_grams(lexicon.forms[some], order)[0])
            for layer, names in enumerate((list(lower), list(dict.fromkeys(class_texts(classes, order))))):
                for i in range(0, len(names), 65_536):
                    some = names[i : i + 65_536]
                    yield pa.record_batch([pa.array([own] * len(some), pa.int32()), pa.array([layer] * len(some), pa.int8()), pa.array(some, pa.string())], ["chunk", "layer", "gram"])

        for b in batches:
            for part in slices(b, "text", max_bytes=SLICE_BYTES):
                chunks_, texts = part.column("chunk").to_numpy(), part.column("text")
                for chunk in np.unique(chunks_).tolist():
                    if chunk != own:
                        yield from asked()
                        own, lexicon, classes = chunk, Lexicon(), np.zeros(0, np.uint64)
                    numbers, ends = lexicon.read(texts.filter(pa.array(chunks_ == chunk)).to_pylist())
                    classes = np.union1d(classes, class_codes(lexicon, numbers, ends, order))
        yield from asked()

    def add(texts: pa.Table, answers: pa.Table) -> pa.Table:
        def costs_of(layer: int) -> dict[str, int]:
            own = answers.filter(pc.equal(answers.column("layer"), layer))
            return dict(zip(own.column("gram").to_pylist(), own.column("cost").to_pylist(), strict=True))

        upper = costs_of(1)
        lexicon = Lexicon()
        rows, tops = [], []
        for batch in texts.to_batches():
            for part in slices(batch, "text", max_bytes=SLICE_BYTES):
                numbers, ends = lexicon.read(part.column("text").to_pylist())
                codes, at = np.unique(class_codes(lexicon, numbers, ends, order), return_inverse=True)
                own = np.array([upper[g] for g in class_texts(codes, order)], np.int64)
                tops.append(sums(own[at], ends))
                rows.append((numbers.astype(np.int32), ends))
        del upper
        lower = costs_of(0)
        price, size = np.zeros(len(lexicon.forms), np.int64), np.zeros(len(lexicon.forms), np.int64)
        for some in pieces(len(lexicon.forms)):
            names, at, ends = form_grams(lexicon.forms[some], order)
            price[some] = sums(np.array([lower[g] for g in names], np.int64)[at], ends)
            size[some] = np.diff(np.concatenate([[0], ends]))
        del lower, lexicon
        symbols = np.concatenate([np.zeros(0, np.int64), *(sums(size[numbers], ends) for numbers, ends in rows)])
        costs = np.concatenate([np.zeros(0, np.int64), *(sums(price[numbers], ends) + top for (numbers, ends), top in zip(rows, tops, strict=True))])
        del rows, tops, price, size
        release_memory()
        return pa.table([texts.column("id"), texts.column("lang"), pa.array(symbols, pa.int64()), pa.array(costs, pa.int64())], ["id", "lang", "symbols", "cost"])

    asked = map_arrow(dealt, ask, "chunk int, layer byte, gram string")
    kind = rows.schema["id"].dataType.simpleString()
    distinct = durable(asked, "asked")
    costs = durable(model.costs(distinct.select("layer", "gram").distinct()), "costs")
    answers = distinct.join(costs, ["layer", "gram"]).select("chunk", "layer", "gram", "cost")
    found = dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(add, f"id {kind}, lang string, symbols long, cost long")
    return found.select(F.col("id").alias(id_col), F.col("lang").alias(lang_col), "symbols", "cost")


def excess(cost: Column, symbols: Column, mean: Column) -> Column:
    """Bits above ``mean`` bits a symbol, over the root of the symbols, in
    thousandths, rounded up; null without symbols."""
    return F.when(symbols > 0, F.ceil((cost / SCALE - mean * symbols) * 1000 / F.sqrt(symbols)))


def limits(scores: DataFrame, held: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """lang, mean and threshold of the ``scores`` (id, lang, symbols, cost) of ``held``
    ids, and every, true in the one row for all languages together. The threshold is the
    quantile of the language's own documents; a language with fewer than ``LEAST_HELD``
    has no row."""
    own = scores.join(sized_broadcast(held), "id", "left_semi").where("symbols > 0")
    both = own.select("lang", F.lit(False).alias("every"), "symbols", "cost").unionByName(own.select(F.lit(None).cast("string").alias("lang"), F.lit(True).alias("every"), "symbols", "cost"))
    key = ["every", "lang"]
    means = both.groupBy(*key).agg((F.sum("cost") / SCALE / F.sum("symbols")).alias("mean"), F.count("*").alias("documents"))
    means = means.where(F.col("every") | (F.col("documents") >= LEAST_HELD)).drop("documents").withColumnsRenamed({"every": "m_every", "lang": "m_lang"})
    same = (F.col("every") == F.col("m_every")) & F.col("lang").eqNullSafe(F.col("m_lang"))
    over = excess(F.col("cost"), F.col("symbols"), F.col("mean"))
    cells = both.join(sized_broadcast(durable(means, "means")), same).groupBy(*key, "mean", over.alias("excess")).agg(F.count("*").alias("n"))
    cells = durable(cells.withColumn("band", F.floor(F.col("excess") / BAND)), "excess")
    # The band in which the quantile lies is found first, so no task sorts all cells of a language.
    w, whole = W.partitionBy(*key).orderBy("band"), W.partitionBy(*key)
    bands = cells.groupBy(*key, "band").agg(F.sum("n").alias("n"))
    bands = bands.select(*key, "band", (F.sum("n").over(w) - F.col("n")).alias("before"), F.sum("n").over(w).alias("upto"), (F.sum("n").over(whole) * quantile).alias("due"))
    first = F.min_by(F.struct(F.col("band").alias("b_band"), "before", "due"), "band")
    found = bands.where("upto >= due").groupBy(*key).agg(first.alias("b")).select(F.col("every").alias("b_every"), F.col("lang").alias("b_lang"), "b.*")
    here = (F.col("every") == F.col("b_every")) & F.col("lang").eqNullSafe(F.col("b_lang")) & (F.col("band") == F.col("b_band"))
    near = cells.join(sized_broadcast(durable(found, "bands")), here)
    upto = F.col("before") + F.sum("n").over(W.partitionBy(*key).orderBy("excess"))
    return near.select(*key, "mean", "excess", (upto >= F.col("due")).alias("enough")).where("enough").groupBy(*key, "mean").agg(F.min("excess").alias("threshold"))


def judge(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", quantile: float = QUANTILE) -> DataFrame:
    """id, lang, symbols, cost, perplexity, excess, threshold, accepted for each
    document; ``trusted`` has the ids of trusted ones."""
    ids = durable(trusted.select(quoted(id_col).cast(docs.schema[id_col].dataType).alias("id")).where("id is not null").distinct(), "trusted")
    is_held = F.pmod(F.xxhash64("id"), F.lit(HELD_OUT)) == 0
    taught = texts_of(docs, id_col, text_col).join(sized_broadcast(ids.where(~is_held)), "id", "left_semi")
    with scratch() as made:
        model = Layers(count_grams(taught))
        scores = made.keep(durable(score(docs, model, id_col, text_col, lang_col).toDF("id", "lang", "symbols", "cost"), "scores"))
    found = durable(limits(scores, ids.where(is_held), quantile), "limits")
    every = found.where("every").first()
    whole = (every.mean, every.threshold) if every else (None, None)
    own = found.where("not every").select(F.col("lang").alias("own_lang"), "mean", "threshold")
    rows = scores.join(sized_broadcast(own), F.col("lang").eqNullSafe(F.col("own_lang")), "left")  # one row per language, so joins of any size
    mean, limit = F.coalesce("mean", F.lit(whole[0]).cast("double")), F.coalesce("threshold", F.lit(whole[1]).cast("long"))
    over = excess(F.col("cost"), F.col("symbols"), mean)
    perplexity = F.when(F.col("symbols") > 0, F.pow(F.lit(2.0), F.col("cost") / (F.col("symbols") * SCALE)))
    return rows.select(F.col("id").alias(id_col), F.col("lang").alias(lang_col), "symbols", "cost", F.round(perplexity, 6).alias("perplexity"), over.alias("excess"), limit.alias("threshold"), F.coalesce(over <= limit, F.lit(True)).alias("accepted"))


def accepted(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", quantile: float = QUANTILE) -> DataFrame:
    """``docs`` without the rejected ones, all columns kept. A repeated id goes if
    any of its rows is rejected."""
    out = judge(docs, trusted, id_col, text_col, lang_col, quantile).where(~F.col("accepted")).select(quoted(id_col).alias("id")).distinct()
    return without(docs, durable(out, "rejected"), id_col)
