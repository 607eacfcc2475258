"""Toxicity: a weighted lexicon, matched by Aho-Corasick in folded text.

Folding undoes look-alike letters, accents and digits that stand for letters, and
parts words by single blanks. Lexicon words are whole words whose share among toxic
documents is too high for chance; exception phrases are longer patterns around a lexicon
word that silence it. The sum of weights is set against the text's length and turned
into a score whose two numbers are fitted to the labels.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabscout.llm.common import chunks, landed, text_of

#: Digits and signs that stand for letters inside a word.
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "i"}
#: Cyrillic and Greek letters, and others, by the Latin letter they look like.
LOOKALIKES = {
    "a": "аαɑ", "b": "вβ", "c": "сϲ", "d": "ԁ", "e": "еεє", "g": "ɡ",
    "h": "һнη", "i": "іιıї", "j": "ј", "k": "кκ", "l": "ӏ",
    "m": "мμ", "n": "ո", "o": "оοօ", "p": "рρ", "q": "ԛ", "s": "ѕσ",
    "t": "тτ", "u": "υս", "v": "νѵ", "w": "ԝω", "x": "хχ", "y": "уγ",
    "z": "ʐ"}
#: Letters of the stems that are tried.
STEM_LETTERS = (4, 5, 6, 7)
#: The likelihood ratio that a word needs beyond what the best of so many words has by chance.
MIN_RATIO = 4.0
#: Of the places of a word, so many at least are in toxic texts.
MIN_SHARE = 0.75
#: At most so many words, the weightiest; phrases that silence them likewise.
MAX_WORDS = 5000
MAX_PHRASES = 5000
#: At most so many labelled texts of each class are learned from, those of least hash.
SAMPLE_PER_CLASS = 5000
SEED = 11
_INVISIBLE = regex.compile(r"[\p{Mn}\p{Cf}]+")
_SIGNED = regex.compile(
    r"(?<=[^\W\d_])[0134578@$!|]+(?=[^\W\d_])|(?<![\w@$!|])[0134578@$!|]{1,2}(?=[^\W\d_][\w@$!|]*[^\W\d_])"
    r"|(?<=[^\W\d_]{2})[0134578$](?![\w@$!|])")
_GAPS = regex.compile(r"[^a-z]+")


def fold_table() -> dict[int, str]:
    table: dict[int, str] = {ord(c): latin for latin, cs in LOOKALIKES.items() for c in cs}
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00), *range(0xFF00, 0xFF5F)]:
        plain = "".join(c for c in unicodedata.normalize("NFKD", chr(code).lower()) if not unicodedata.combining(c))
        if code not in table and plain and plain.isascii():
            table[code] = plain
    return table | {0xDF: "ss", 0x1E9E: "ss"}


TABLE = fold_table()
DIGIT_TABLE = str.maketrans(DIGITS)


def fold(text: str) -> str:
    """The words of a text in plain letters a-z, one blank between, before and after them."""
    low = text.lower()
    if not low.isascii():
        low = _INVISIBLE.sub("", unicodedata.normalize("NFC", low).translate(TABLE))
    low = _SIGNED.sub(lambda m: m[0].translate(DIGIT_TABLE), low)
    return f" {_GAPS.sub(' ', low).strip()} "


@dataclass
class Lexicon:
    """Weights of folded words (stems end in *), phrases that silence them, and slope and level of the score."""
    words: dict[str, float]
    exceptions: list[str] = field(default_factory=list)
    slope: float = 1.0
    level: float = 0.0

    def automaton(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for word, weight in self.words.items():
            pattern = f" {word}".removesuffix("*") if word.endswith("*") else f" {word} "
            found.add_word(pattern, (len(pattern), weight))
        for phrase in self.exceptions:
            found.add_word(f" {phrase} ", (len(phrase) + 2, None))
        if len(found):
            found.make_automaton()
        return found


def weight_of(folded: str, automaton: ahocorasick.Automaton) -> float:
    """Damped sum of the weights of the matches, over the length: silenced ones count nothing."""
    if not len(automaton):
        return 0.0
    hits, silent = [], []
    for end, (size, weight) in automaton.iter(folded):
        (silent if weight is None else hits).append((end - size + 1, end, weight))
    if not hits:
        return 0.0
    total = sum(w for a, b, w in hits if not any(s <= a and b <= e for s, e, _ in silent))
    return total / (1 + 0.1 * np.log1p(folded.count(" ")))


def counted(texts: DataFrame, of: Callable[[list[str]], set]) -> DataFrame:
    """(word, before, label) of all that `of` finds in each folded text, once per piece of a partition."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text"):
            found = set()
            for text, label in zip(b.column("text").to_pylist(), b.column("label").to_pylist()):
                found |= {(*pair, label) for pair in of(fold(text).split())}
            word, before, label = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(word, pa.string()), pa.array(before, pa.string()),
                                              pa.array(label, pa.int32())], ["word", "before", "label"])

    return texts.select("text", "label").mapInArrow(run, "word string, before string, label int")


def word_table(texts: DataFrame) -> DataFrame:
    """(word, toxic, clean): after how many different words each word stands in texts of either kind.

    Copies of a text, near ones too, repeat the words before, so they count once."""
    places = counted(texts, lambda words: set(zip(words, ["", *words])))
    per = places.groupBy("word", "before").agg(F.max("label").alias("t"), F.max(1 - F.col("label")).alias("c"))
    return per.groupBy("word").agg(F.sum("t").alias("toxic"), F.sum("c").alias("clean"))


def learn_words(texts: DataFrame) -> dict[str, float]:
    """Words and stems of toxic texts with their weights, at most MAX_WORDS."""
    words = landed(word_table(texts))
    total = words.agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"),
                      F.sum((F.col("toxic") >= 3).cast("long")).alias("n")).first()
    if not total["t"] or not total["c"]:
        return {}
    stems = words.select(F.explode(F.array(*[F.struct(
        F.concat(F.substring("word", 1, k), F.lit("*")).alias("word"), F.col("toxic"), F.col("clean"),
        (F.length("word") > k).alias("longer")) for k in STEM_LETTERS])).alias("s")).select("s.*").where("longer").groupBy(
        "word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    share = total["t"] / (total["t"] + total["c"])
    t, c = F.col("toxic"), F.col("clean")

    def part(k: Column, e: float) -> Column:
        return F.when(k > 0, k * F.log(k / ((t + c) * F.lit(e)))).otherwise(0.0)

    ratio = 2 * (part(t, share) + part(c, 1 - share))
    weight = F.log((t + 0.5) / (total["t"] + 1)) - F.log((c + 0.5) / (total["c"] + 1))
    least = MIN_RATIO + 2 * math.log(max(total["n"], 1))
    kept = words.unionByName(stems).where((t >= 3) & (t >= (t + c) * MIN_SHARE) & (t > (t + c) * share)).select(
        "word", ratio.alias("ratio"), weight.alias("weight")).where(F.col("ratio") > least)
    out: dict[str, float] = {}
    for r in kept.orderBy(F.desc("ratio"), F.desc(F.length("word")), "word").limit(MAX_WORDS).collect():
        word = r["word"].removesuffix("*")
        if not any(f"{word[:k]}*" in out for k in STEM_LETTERS) and not any(w.startswith(word) for w in out):
            out[r["word"]] = r["weight"]
    return out


def learn_exceptions(texts: DataFrame, words: dict[str, float]) -> list[str]:
    """Pairs of words, one of them in the lexicon, that at least 3 clean texts hold in different places and no toxic one."""
    def pairs(found: list[str]) -> set:
        hit = [w in words or any(f"{w[:k]}*" in words for k in STEM_LETTERS) for w in found]
        return {(f"{x} {y}", z) for x, y, z, h, i in zip(found, found[1:], ["", *found], hit, hit[1:]) if h or i}

    per = counted(texts, pairs).groupBy("word", "before").agg(F.max("label").alias("t"), F.max(1 - F.col("label")).alias("c"))
    kept = per.groupBy("word").agg(F.sum("t").alias("toxic"), F.sum("c").alias("clean")).where("toxic = 0 and clean >= 3")
    return [r["word"] for r in kept.orderBy(F.desc("clean"), "word").limit(MAX_PHRASES).collect()]


def fit_score(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Slope and level of a logistic curve over weighted points, by Newton steps with a little damping."""
    at = np.zeros(2)
    a = np.stack([x, np.ones_like(x)], 1)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a @ at, -30, 30)))
        grad = a.T @ (w * (p - y)) + 1e-2 * at
        hess = (a * (w * p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(2)
        at -= np.clip(np.linalg.solve(hess, grad), -2, 2)
    return float(at[0]), float(at[1])


def train(docs: DataFrame, labels: DataFrame, label_col: str, usable: Column | None = None, id_col: str = "doc_id",
          text_col: str = "text", exceptions: list[str] | None = None) -> Lexicon:
    """Learn from at most SAMPLE_PER_CLASS usable labelled texts of each class, whole.

    The driver gets at most MAX_WORDS words, MAX_PHRASES phrases and one number a
    text. exceptions: phrases to use instead of learned ones. Rows without a label teach
    nothing; without toxic or without clean rows the lexicon is empty and the score flat."""
    rows = labels if usable is None else labels.where(usable)
    rows = rows.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("label"))
    rows = rows.where("id is not null and label is not null").groupBy("id").agg(F.max("label").alias("label"))
    n = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not n.get(1) or not n.get(0):
        return Lexicon({}, [], 0.0, 3.0 if n.get(1) else -3.0)
    order = F.xxhash64(F.col("id").cast("string"), F.lit(SEED))
    picked = rows.where("label = 1").orderBy(order, "id").limit(SAMPLE_PER_CLASS).unionAll(
        rows.where("label = 0").orderBy(order, "id").limit(SAMPLE_PER_CLASS))
    texts = landed(docs.select(F.col(f"`{id_col}`").alias("id"), text_of(f"`{text_col}`").alias("text")).join(
        F.broadcast(picked), "id").select("label", "text"))
    lexicon = Lexicon(learn_words(texts))
    lexicon.exceptions = learn_exceptions(texts, lexicon.words) if exceptions is None else [
        fold(e).strip() for e in exceptions]
    got = weights(texts, lexicon, ["label"], "text").toPandas().sort_values(["label", "weight"])
    y = got["label"].to_numpy(float)
    each = {k: n[k] / max((y == k).sum(), 1) for k in (0, 1)}
    lexicon.slope, lexicon.level = fit_score(got["weight"].to_numpy(float), y, np.where(y == 1, each[1], each[0]))
    return lexicon


def weights(docs: DataFrame, lexicon: Lexicon, keep: list[str], text_col: str) -> DataFrame:
    """The columns to keep of every row, and the weight of its whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], text_of(f"`{text_col}`").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.value.automaton()
        for b in chunks(batches, "_text"):
            w = [weight_of(fold(t), automaton) for t in b.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:len(keep)], pa.array(w, pa.float64())], [*keep, "weight"])

    kinds = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep]
    return rows.mapInArrow(run, ", ".join([*kinds, "weight double"]))


def score(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, weight, score) of every row from its whole text; null counts as empty, repeated rows score alike."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    logit = F.col("weight") * lexicon.slope + lexicon.level
    return weights(rows, lexicon, ["id"], "text").select("id", "weight", (1 / (1 + F.exp(-logit))).alias("score"))
