"""Language identification with spans.

The letters' script ranges narrow the candidate languages of a word, character
n-grams score the word for each candidate, and a Viterbi pass over the words
with a switching penalty labels spans, so mixed texts come apart into
languages. A text's language is the one that labels most of its letters.

The model is fitted on a bounded sample of the labelled rows (``SAMPLE_PER_LANG``
documents of each language, by a hash of the id; whole texts) and has a fixed
number of hashed n-gram features per language, so what reaches the driver and
the workers does not grow with the corpus.

Defined results: null text and texts without a letter: ``und``, score 0, no
spans. No labelled rows: everything is ``und``, and ``keep_identified`` keeps
every text with letters. Letters of a script that no
learned language uses: all languages stay candidates. Ties: the language first
in alphabetical order. Repeated rows and null ids keep one output row each (a
null id is not held out and not learned from). Very long texts are labelled
whole, in blocks. Only the named columns are read, so others cannot clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.llm.common import batches_of

SAMPLE_PER_LANG = 3000  # documents of each language that the model is fitted on, about
BUCKETS = 1 << 16       # hashed n-gram features
ORDERS = (1, 2, 3)      # n-gram lengths, word boundaries included
SWITCH = 9.0            # penalty for changing the language between two words
TEMPER = 0.6            # n-grams of a word overlap, so their evidence is weighted down
SCRIPT_SHARE = 0.002    # share of a language's letters that makes a script its own
WORD_CACHE = 50_000
BATCH_ROWS = 256
BLOCK = 256             # words of a Viterbi block

WORD = re.compile(r"[^\W\d_]+")
# First code points of Unicode ranges and the script that each starts.
SCRIPT_RANGES = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0700, "other"), (0x0750, "arabic"), (0x0780, "other"), (0x08A0, "arabic"),
    (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "other"), (0x0B80, "tamil"), (0x0C00, "other"),
    (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"),
    (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"), (0x3040, "kana"),
    (0x3100, "han"), (0x3130, "hangul"), (0x3190, "han"), (0xA000, "other"), (0xA640, "cyrillic"), (0xA6A0, "other"),
    (0xA720, "latin"), (0xA800, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"),
    (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE00, "other"), (0xFE70, "arabic"), (0xFF00, "latin"),
    (0xFF66, "kana"), (0xFFA0, "other"), (0x20000, "han")]
_STARTS = np.array([s for s, _ in SCRIPT_RANGES])
SCRIPTS = sorted({n for _, n in SCRIPT_RANGES})
_SCRIPT_OF = np.array([SCRIPTS.index(n) for _, n in SCRIPT_RANGES])


def letters_only(words: list[str]) -> list[str]:
    return [w for w in words if w.isalpha() or any(c.isalpha() for c in w)]


def words_of(text: str) -> list[str]:
    return letters_only(WORD.findall(text))


def _codes(words: list[str]) -> np.ndarray:
    return np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word index, bucket) of all n-grams and the script of each word. Words
    are lower-cased; n-grams reach over a word's ends but not into the next."""
    codes = _codes([w.lower() for w in words])
    gap = codes == 32
    word = np.cumsum(gap) - 1  # of the characters after each gap
    at, bucket = [], []
    for n in ORDERS:
        m = len(codes) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n, np.uint64)
        for i in range(n):
            h = h * np.uint64(0x9E3779B97F4A7C15) + codes[i:i + m]
        inner = np.zeros(m, bool)
        for i in range(1, n - 1):
            inner |= gap[i:i + m]
        ok = ~inner & ~(gap[:m] & gap[n - 1:n - 1 + m])
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        at.append(word[:m][ok])
        bucket.append((h[ok] >> np.uint64(64 - 16)).astype(np.int64) % BUCKETS)
    first = codes[np.flatnonzero(gap)[:-1] + 1]
    script = _SCRIPT_OF[np.searchsorted(_STARTS, first, side="right") - 1]
    return np.concatenate(at), np.concatenate(bucket), script


@dataclass
class Model:
    langs: list[str]
    weight: np.ndarray   # BUCKETS x languages: log probability of an n-gram
    allowed: np.ndarray  # scripts x languages

    def score(self, words: list[str]) -> np.ndarray:
        """words x languages; languages outside a word's script get the lowest score less a margin."""
        at, bucket, script = features(words)
        out = np.empty((len(words), len(self.langs)), np.float64)
        for j in range(len(self.langs)):
            out[:, j] = np.bincount(at, weights=self.weight[bucket, j], minlength=len(words))
        out *= TEMPER
        out -= out.max(axis=1, keepdims=True)
        return np.where(self.allowed[script], out, out.min(axis=1, keepdims=True) - SWITCH)


def _counts(langs: list[str]):
    index = {x: i for i, x in enumerate(langs)}

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = np.zeros((len(langs), BUCKETS), np.int64)
        scripts = np.zeros((len(langs), len(SCRIPTS)), np.int64)
        for b in batches_of(BATCH_ROWS, it):
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = words_of(text or "")
                if words:
                    _, bucket, script = features(words)
                    grams[index[lang]] += np.bincount(bucket, minlength=BUCKETS)
                    sizes = np.fromiter(map(len, words), np.int64, len(words))
                    scripts[index[lang]] += np.bincount(script, weights=sizes, minlength=len(SCRIPTS)).astype(np.int64)
        both = np.concatenate([grams, scripts], 1)
        lang, cell = np.nonzero(both)
        yield pa.RecordBatch.from_arrays([pa.array(lang, pa.int32()), pa.array(cell, pa.int32()),
                                          pa.array(both[lang, cell], pa.int64())], ["lang", "cell", "n"])
    return run


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          sample_per_lang: int = SAMPLE_PER_LANG) -> Model:
    """Learns from text and non-null language of rows that are not held out."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull()
                      & ~held_out(id_col)).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"),
                                                  F.col(lang_col).cast("string").alias("lang"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros((len(SCRIPTS), 0), bool))
    share = F.create_map(*[x for lang in langs for x in (F.lit(lang), F.lit(sample_per_lang / sizes[lang]))])
    sample = rows.where((F.pmod(F.xxhash64("id"), F.lit(1 << 20)) / float(1 << 20)) < share[F.col("lang")])
    cells = (sample.select("text", "lang").mapInArrow(_counts(langs), "lang int, cell int, n long")
             .groupBy("lang", "cell").agg(F.sum("n").alias("n")).toArrow())
    both = np.zeros((len(langs), BUCKETS + len(SCRIPTS)))
    both[cells["lang"].to_numpy(), cells["cell"].to_numpy()] = cells["n"].to_numpy()
    grams, scripts = both[:, :BUCKETS], both[:, BUCKETS:]
    weight = np.log((grams + 0.5) / (grams.sum(1, keepdims=True) + 0.5 * BUCKETS)).T
    allowed = (scripts > SCRIPT_SHARE * np.maximum(scripts.sum(1, keepdims=True), 1)).T
    allowed[~allowed.any(1)] = True
    return Model(langs, np.ascontiguousarray(weight), allowed)


def viterbi(scores: list[np.ndarray], penalty: float = SWITCH) -> list[np.ndarray]:
    """Best label sequence of each item (words x languages), where a change of
    label costs ``penalty``. Long items are cut into blocks: every block's best
    score for each pair of first and last label, the blocks joined in order, and
    the chosen paths decoded block by block. All blocks advance together."""
    langs = scores[0].shape[1]
    spans = [(d, at, min(at + BLOCK, len(s))) for d, s in enumerate(scores) for at in range(0, len(s), BLOCK)]
    by_size = sorted(range(len(spans)), key=lambda i: spans[i][1] - spans[i][2])
    size = np.array([spans[i][2] - spans[i][1] for i in by_size])
    padded = np.zeros((BLOCK, len(spans), langs))
    for col, i in enumerate(by_size):
        d, a, b = spans[i]
        padded[:b - a, col] = scores[d][a:b]
    live = [int((size > t).sum()) for t in range(BLOCK)]
    # best score of a block from each first label to each last label
    best = np.full((len(spans), langs, langs), -np.inf)
    best[:, np.arange(langs), np.arange(langs)] = padded[0]
    for t in range(1, int(size.max())):
        n = live[t]
        top = best[:n].max(axis=2, keepdims=True) - penalty
        best[:n] = np.maximum(best[:n], top) + padded[t, :n, None, :]
    # join the blocks of each item, then go back for their first and last labels
    column = np.empty(len(spans), np.int64)
    column[by_size] = np.arange(len(spans))
    enter, leave = np.zeros(len(spans), np.int64), np.zeros(len(spans), np.int64)
    i = 0
    while i < len(spans):
        j = i
        while j < len(spans) and spans[j][0] == spans[i][0]:
            j += 1
        state, back = np.zeros(langs), []
        for b in range(i, j):
            start = np.maximum(state, state.max() - penalty) if b > i else state
            came = np.where(state >= state.max() - penalty, np.arange(langs), state.argmax()) if b > i else None
            total = start[:, None] + best[column[b]]
            first = total.argmax(axis=0)
            back.append((came, first))
            state = total[first, np.arange(langs)]
        label = int(state.argmax())
        for b in range(j - 1, i - 1, -1):
            came, first = back[b - i]
            leave[b], enter[b] = label, first[label]
            label = int(came[first[label]]) if came is not None else label
        i = j
    # decode the chosen path of every block
    state = np.full((len(spans), langs), -np.inf)
    state[np.arange(len(spans)), enter[by_size]] = padded[0][np.arange(len(spans)), enter[by_size]]
    turned = np.zeros((BLOCK, len(spans), langs), bool)
    source = np.zeros((BLOCK, len(spans)), np.int64)
    for t in range(1, int(size.max())):
        n = live[t]
        source[t, :n] = state[:n].argmax(axis=1)
        top = state[:n].max(axis=1, keepdims=True) - penalty
        turned[t, :n] = state[:n] < top
        state[:n] = np.maximum(state[:n], top) + padded[t, :n]
    path = np.zeros((BLOCK, len(spans)), np.int64)
    label = leave[by_size].copy()
    for t in range(int(size.max()) - 1, -1, -1):
        n = live[t]
        path[t, :n] = label[:n]
        if t:
            changed = turned[t, np.arange(n), label[:n]]
            label[:n] = np.where(changed, source[t, :n], label[:n])
    out = []
    for b, (d, a, e) in enumerate(spans):
        if a == 0:
            out.append(np.empty(len(scores[d]), np.int64))
        out[-1][a:e] = path[:e - a, column[b]]
    return out


class Labeller:
    """Scores of words seen before are kept, up to a bound."""

    def __init__(self, model: Model):
        self.model, self.index, self.table = model, {}, np.zeros((0, len(model.langs)))

    def score(self, docs: list[list[str]]) -> list[np.ndarray]:
        if len(self.index) > WORD_CACHE:
            self.index, self.table = {}, self.table[:0]
        fresh = {w for words in docs for w in words if w not in self.index}
        if fresh:
            fresh = sorted(fresh)
            self.index |= zip(fresh, range(len(self.table), len(self.table) + len(fresh)))
            self.table = np.concatenate([self.table, self.model.score(fresh)])
        return [self.table[[self.index[w] for w in words]] for words in docs]

    def label(self, texts: list[str | None]) -> list[tuple[str, float, list]]:
        """Per text: language, score, spans (start, end, language) by code point."""
        langs = self.model.langs
        words = [words_of(t or "") if langs else [] for t in texts]
        some = [i for i, w in enumerate(words) if w]
        out: list = [("und", 0.0, [])] * len(texts)
        if not some:
            return out
        scores = self.score([words[i] for i in some])
        for i, s, path in zip(some, scores, viterbi(scores)):
            sizes = np.fromiter(map(len, words[i]), np.int64, len(words[i]))
            share = np.bincount(path, weights=sizes, minlength=len(langs)) / sizes.sum()
            top = int(share.argmax())
            total = s[path == top].sum(axis=0)
            sure = 1 / np.exp(np.clip(total - total[top], -700, 0 if len(langs) == 1 else 50)).sum()
            turns = np.flatnonzero(np.diff(path)) + 1
            starts = [0]
            if len(turns):
                places = [m.start() for m in WORD.finditer(texts[i]) if letters_only([m[0]])]
                starts += [places[t] for t in turns]
            ends = starts[1:] + [len(texts[i])]
            labels = path[np.concatenate([[0], turns]).astype(np.int64)]
            out[i] = (langs[top], float(min(1.0, share[top] * min(1.0, sure))),
                      [{"start": a, "end": e, "lang": langs[x]} for a, e, x in zip(starts, ends, labels)])
        return out


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, lang_pred, score, spans. Row-local: no shuffle."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(model)
        for b in batches_of(BATCH_ROWS, it):
            got = labeller.label(b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([g[0] for g in got], pa.string()),
                 pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], SPANS)],
                ["id", "held_out", "lang_pred", "score", "spans"])

    return docs.select(F.col(id_col).cast("long").alias("id"), held_out(id_col).alias("held_out"),
                       F.col(text_col).alias("text")) \
        .mapInArrow(run, "id long, held_out boolean, lang_pred string, score double, "
                    "spans array<struct<start:bigint,end:bigint,lang:string>>").withColumnRenamed("id", id_col)


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text", least_score: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, whose language is known with a score
    of at least ``least_score``; rows without letters and rows without a
    prevailing language go. If no language was learned, none can be told from
    another: all rows with letters stay."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(model)
        for b in batches_of(BATCH_ROWS, it):
            texts = b.column(b.schema.get_field_index(text_col)).to_pylist()
            if model.langs:
                stay = [g[0] != "und" and g[1] >= least_score for g in labeller.label(texts)]
            else:
                stay = [bool(words_of(t or "")) for t in texts]
            yield b.filter(pa.array(stay, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
