"""Toxicity: gradient-boosted trees over dense features of a text, with isotonic calibration.

Features: densities and counts of a fixed lexicon and of one learned from the labelled rows (words and word beginnings), how near its hits
stand to the second person, shares of capitals, punctuation and exclamation marks, and of words with symbols or digits put inside them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kinetrail.llm import kernels as K
from kinetrail.llm.labelled import Isotonic, sample, texts_of
from kinetrail.llm.trees import Boosted

U64 = np.uint64
#: Insults in the four languages of the corpus, lower case.
LEXICON = """
arsehole asshole bastard bitch clown creep cretin damn degenerate disgusting dumb dumbass fool freak fuck fucking garbage hate idiot idiotic
idiots imbecile jerk liar loser losers moron moronic morons parasite pathetic piece-of-shit pig retard scum scumbag shit shut stupid stupidity trash
ugly useless vermin vile whore worthless
abruti bouffon connard connasse crétin débile enculé imbécile merde minable ordure pourriture racaille salaud salope stupide
abschaum arschloch blöd blödmann depp dreck dumm dummkopf erbärmlich hurensohn idioten mistkerl nutzlos schlampe trottel versager wertlos widerlich
basura cabrón estúpido gilipollas idiota imbécil inútil mierda patético payaso perdedor puta tonto escoria asqueroso
""".split()
SECOND_PERSON = "you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch euer tú ti tus usted ustedes vosotros vuestro".split()
#: Lengths in bytes of the word beginnings that the learned lexicon counts; 0 is the whole word.
BEGINNINGS = (0, 4, 5, 6, 7, 8)
NEAR = 4
NAMES = ("hits", "hit_density", "learned", "learned_density", "learned_kinds", "strongest", "near_you", "you_density", "capitals", "all_capital_words", "punctuation", "exclamations", "obfuscated", "log_words")


def _hash_words(words: list[str]) -> np.ndarray:
    data, offs = K.buffers(pa.array(words, pa.large_string()))
    return np.sort(K.span_hashes(data, offs[:-1], offs[1:], lower=True))


_FIXED, _YOU = _hash_words(LEXICON), _hash_words(SECOND_PERSON)


def _contained(h: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table) or not len(h):
        return np.zeros(len(h), bool)
    bits = np.zeros(1 << 16, bool)
    bits[(table >> U64(48)).astype(np.int64)] = True
    out = bits[(h >> U64(48)).astype(np.int64)]
    at = np.flatnonzero(out)
    out[at] = table[np.minimum(np.searchsorted(table, h[at]), len(table) - 1)] == h[at]
    return out


def _word_keys(part: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """For each length of BEGINNINGS, the words that reach it and the hashes of their beginnings."""
    for n in BEGINNINGS:
        at = np.arange(len(starts)) if not n else np.flatnonzero(ends - starts >= n)
        stop = ends if not n else starts[at] + n
        yield at, K.mix(K.span_hashes(part, starts[at], stop, lower=True) + U64(n))


class Lexicon:
    """Word keys that mark toxic texts in the labelled sample, with their log odds."""

    def __init__(self, keys: np.ndarray, odds: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.odds = keys[order].astype(U64), odds[order]

    def weights(self, part, starts, ends) -> np.ndarray:
        """Each word's largest log odds, 0 for most."""
        out = np.zeros(len(starts))
        for at, key in _word_keys(part, starts, ends):
            hit = np.flatnonzero(_contained(key, self.keys))
            np.maximum.at(out, at[hit], self.odds[np.searchsorted(self.keys, key[hit])])
        return out


def features(column: pa.Array, lexicon: Lexicon) -> np.ndarray:
    data, offs = K.buffers(column)
    out = np.zeros((len(column), len(NAMES)))
    for lo, hi in K.groups(offs):
        part, o = data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        starts, ends, first = K.word_bounds(part, o, K.ALNUM)
        h = K.span_hashes(part, starts, ends, lower=True)
        fixed, you, odds = _contained(h, _FIXED), _contained(h, _YOU), lexicon.weights(part, starts, ends)
        words = np.diff(first)
        n, chars = np.maximum(words, 1), np.maximum(np.diff(o), 1)
        x = out[lo:hi]
        x[:, 0] = K.sums(fixed, first)
        x[:, 1] = 100 * x[:, 0] / n
        x[:, 2] = K.sums(odds, first)
        x[:, 3] = 100 * x[:, 2] / n
        x[:, 4] = K.sums(odds > 0, first)
        doc = K.runs(words)
        np.maximum.at(x[:, 5], doc, odds)
        last = np.concatenate([[0], np.cumsum(you)])
        bad = np.flatnonzero(fixed | (odds > 0))
        a, b = np.maximum(bad - NEAR, first[:-1][doc[bad]]), np.minimum(bad + NEAR + 1, first[1:][doc[bad]])
        x[:, 6] = np.bincount(doc[bad], last[b] > last[a], minlength=hi - lo)
        x[:, 7] = 100 * K.sums(you, first) / n
        upper = (part >= 65) & (part <= 90)
        letters = K.sums(K.ALNUM[part], o)
        x[:, 8] = K.sums(upper, o) / np.maximum(letters, 1)
        c = np.concatenate([[0], np.cumsum(upper)])
        x[:, 9] = K.sums((c[ends] - c[starts] == ends - starts) & (ends - starts > 1), first) / n
        symbol = K.CLASS[part] == 2
        x[:, 10] = K.sums(symbol, o) / chars
        x[:, 11] = K.sums(part == ord("!"), o) / chars
        inside = symbol.copy()
        inside[1:] &= K.ALNUM[part[:-1]]
        inside[:-1] &= K.ALNUM[part[1:]]
        inside &= (part != ord("'")) & (part != ord("-")) & (part != ord("."))
        x[:, 12] = K.sums(inside, o) / n
        x[:, 13] = np.log1p(words)
    return out


class Toxicity:
    """fit() on at most max_rows labelled documents outside the held-out fold; score() gives doc_id, toxicity.

    A quarter of the sample (every fourth row by hash order) calibrates the scores; the lexicon and the trees see the rest. Inputs of a score are
    the text's features only. A null text counts as empty and gets the score of a text without hits. Repeated rows and ties get equal
    scores; extra columns are ignored; an empty table gives an empty result; without labels every score is 0.
    """

    def __init__(self, max_rows: int = 6000, held_out: int | None = 1, max_lexicon: int = 4000):
        self.max_rows, self.held_out, self.max_lexicon = max_rows, held_out, max_lexicon
        self.model: tuple[Lexicon, Boosted, Isotonic | None] | None = None

    def _learn_lexicon(self, texts: DataFrame) -> Lexicon:
        """Keys in many toxic and few other texts. What reaches the driver is bounded by the sample: the toxic rows' keys, then the other rows' hits among the candidates."""

        def keys_of(column):
            data, offs = K.buffers(column)
            for lo, hi in K.groups(offs):
                part = data[offs[lo] : offs[hi]]
                starts, ends, first = K.word_bounds(part, offs[lo : hi + 1] - offs[lo], K.ALNUM)
                doc = K.runs(np.diff(first))
                pairs = [(doc[at], key) for at, key in _word_keys(part, starts, ends)]
                d, k = K.distinct(np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs]))
                yield hi - lo, d, k

        def collect(rows, within):
            def run(batches):
                for b in batches:
                    blobs = []
                    for n, d, k in keys_of(b.column("text")):
                        if within is not None:
                            ok = _contained(k, within.value)
                            d, k = d[ok], k[ok]
                        blobs += [k[a:z].tobytes() for a, z in zip(*(np.searchsorted(d, np.arange(n), side) for side in ("left", "right")), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(blobs, pa.binary())], ["k"])

            found = [np.frombuffer(r.k, U64) for r in rows.mapInArrow(run, "k binary").collect()]
            return len(found), *np.unique(np.concatenate(found) if found else np.zeros(0, U64), return_counts=True)

        toxic, keys, seen = collect(texts.where("y = 1"), None)
        keys, seen = keys[seen >= max(3, 0.005 * toxic)], seen[seen >= max(3, 0.005 * toxic)]
        clean, others, in_clean = collect(texts.where("y = 0"), texts.sparkSession.sparkContext.broadcast(keys))
        at_clean = np.zeros(len(keys))
        at_clean[np.searchsorted(keys, others)] = in_clean
        odds = np.log((seen + 0.1) / (toxic + 1)) - np.log((at_clean + 0.5) / (clean + 1))
        good = np.flatnonzero(odds > 2.5)
        good = good[np.argsort(-odds[good], kind="stable")][: self.max_lexicon]
        return Lexicon(keys[good], odds[good])

    def fit(self, docs: DataFrame, labels: DataFrame) -> Toxicity:
        picked = sample(labels, "toxic", self.max_rows, self.held_out)
        texts = texts_of(docs, picked).withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(4))).cache()
        lexicon = self._learn_lexicon(texts.where("part != 0"))
        spread = docs.sparkSession.sparkContext.broadcast(lexicon)

        def run(batches):
            for b in batches:
                x = features(b.column("text"), spread.value)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), b.column("part"), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "y", "part", "x"])

        rows = sorted(texts.mapInArrow(run, "doc_id long, y int, part long, x array<double>").collect())
        texts.unpersist()
        x, y, part = np.array([r.x for r in rows]).reshape(len(rows), len(NAMES)), np.array([r.y for r in rows], float), np.array([r.part for r in rows])
        fit, aside = part != 0, part == 0
        trees = Boosted().fit(x[fit], y[fit])
        self.model = (lexicon, trees, Isotonic(trees.margin(x[aside]), y[aside]) if aside.any() else None)
        return self

    def score(self, docs: DataFrame) -> DataFrame:
        model = docs.sparkSession.sparkContext.broadcast(self.model)

        def run(batches):
            lexicon, trees, curve = model.value
            for b in batches:
                margin = trees.margin(features(b.column("text"), lexicon))
                p = np.round(curve(margin), 9) if curve else np.zeros(len(margin))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(p)], ["doc_id", "toxicity"])

        docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        return docs.mapInArrow(run, "doc_id long, toxicity double")
