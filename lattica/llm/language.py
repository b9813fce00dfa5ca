"""Language identification of spans: script ranges narrow the candidates of each word, and Viterbi decoding with a
switching penalty labels the words of mixed texts."""

from __future__ import annotations

import math
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import crc_mod, documents

# First code points of ranges and their scripts, from the Unicode blocks. Others are "other".
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0780, "other"), (0x0900, "devanagari"),
    (0x0980, "bengali"), (0x0A00, "other"), (0x0B80, "tamil"), (0x0C00, "other"), (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"),
    (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"), (0x3040, "kana"), (0x3100, "other"),
    (0x3400, "han"), (0xA000, "other"), (0xA720, "latin"), (0xA800, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"),
    (0xFF21, "latin"), (0xFF5B, "other"), (0x20000, "han"),
)
_STARTS = [x for x, _ in SCRIPTS]

#: Documents that the model is fitted on, about, and features that it keeps: the bounds of the model.
MAX_TRAINING_DOCS, MAX_FEATURES = 20_000, 60_000
#: Log-probability that a change of language costs, and what a language costs outside its scripts.
SWITCH, OUTSIDE = 12.0, 25.0
#: Least share of a language's words in a script that makes it a candidate there.
LEAST_SHARE = 0.001
UNKNOWN = "und"
#: So many texts, or fewer, are decoded one by one.
FEW = 8
#: Tokens whose scores a task keeps, and that are scored at a time.
MAX_CACHE, PIECE = 200_000, 20_000
#: Words that are decoded at once, times languages, and the texts that are cut into words at a time, in characters. A longer
#: text is decoded alone.
CHUNK, CHARS = 3_000_000, 4_000_000


def script(word: str) -> str:
    return SCRIPTS[bisect_right(_STARTS, ord(word[0])) - 1][1]


def letters(token: str) -> str:
    """A token's letters in lower case."""
    low = token.lower()
    return low if low.isalpha() else "".join(filter(str.isalpha, low))


def features(word: str) -> list[str]:
    """The word itself and its trigrams with ends."""
    framed = f"^{word}$"
    return [f"={word}", *(framed[i : i + 3] for i in range(len(framed) - 2))]


@dataclass
class Model:
    langs: list[str]
    #: feature -> row of log-probabilities by language; the last row is that of unknown features.
    index: dict[str, int]
    matrix: np.ndarray
    scripts: dict[str, np.ndarray]

    def scores(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Scores of tokens by language, and whether each has letters. A token without has zeros; a word in a script of no
        language is alike for all."""
        words = [letters(t) for t in tokens]
        get, unknown = self.index.get, len(self.index)
        rows: list[int] = []
        size = np.zeros(len(words), np.int64)
        for i, word in enumerate(words):
            if word:
                found = features(word)
                rows += [get(f, unknown) for f in found]
                size[i] = len(found)
        out = np.zeros((len(words), max(len(self.langs), 1)), np.float32)
        some = np.flatnonzero(size)
        if len(some) and self.langs:
            first = (np.cumsum(size) - size)[some]
            out[some] = np.add.reduceat(self.matrix[rows], first, 0) / np.sqrt(size[some])[:, None]
            kind = [script(words[i]) for i in some]
            names = sorted(set(kind))
            outside = np.array([np.where(self.scripts[k], 0, OUTSIDE) if k in self.scripts else np.full(len(self.langs), np.nan) for k in names])
            out[some] -= outside[[names.index(k) for k in kind]]
            out[np.isnan(out)] = 0
        return out, size > 0


class Scorer:
    """A task's scores of tokens under a model. Tokens are scored once; the cache is dropped at `limit` tokens, which bounds
    its memory and changes no result."""

    def __init__(self, model: Model, limit: int):
        self.model, self.limit = model, limit
        self.cache: dict[str, int] = {}
        self.table, self.lettered = model.scores([])

    def rows(self, tokens: list[list[str]]) -> list[np.ndarray]:
        """Rows of the tables for each text's tokens."""
        seen = set().union(*tokens)
        missing = seen.difference(self.cache)
        if missing and len(self.cache) + len(missing) > self.limit:
            self.cache.clear()
            missing = seen
        n = len(self.cache)
        if missing:
            missing = list(missing)
            self.cache.update(zip(missing, range(n, n + len(missing)), strict=True))
            if n + len(missing) > len(self.table):  # room for twice as many
                room = 2 * (n + len(missing))
                self.table, self.lettered = np.resize(self.table, (room, self.table.shape[1])), np.resize(self.lettered, room)
            for k in range(0, len(missing), PIECE):
                part = missing[k : k + PIECE]
                self.table[n + k : n + k + len(part)], self.lettered[n + k : n + k + len(part)] = self.model.scores(part)
        return [np.fromiter(map(self.cache.__getitem__, x), np.int64, len(x)) for x in tokens]


def fit(labelled: DataFrame, max_docs: int = MAX_TRAINING_DOCS, max_features: int = MAX_FEATURES) -> Model:
    """A model of labelled (doc_id, text, lang), fitted on a sample by a hash of doc_id of about max_docs rows. Tasks count
    features of each language; of the totals the max_features most frequent go to the driver."""
    labelled = labelled.where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", "lang")
    share = min(1.0, max_docs / max(labelled.select("lang").count(), 1))
    sample = labelled.where(F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("text", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_lang: dict[str, Counter] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, tokens in by_lang.items():
                found: Counter = Counter()
                for token, n in tokens.items():
                    if word := letters(token):
                        found[f"@{script(word)}"] += n
                        for f in features(word):
                            found[f] += n
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array([lang] * len(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["feature", "lang", "n"])
            by_lang.clear()

        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1), strict=True):
                by_lang.setdefault(lang.as_py(), Counter()).update(text.as_py().split())
                if sum(map(len, by_lang.values())) >= MAX_CACHE:
                    yield from flush()
        yield from flush()

    counts = sample.mapInArrow(count, "feature string, lang string, n long").groupBy("feature", "lang").agg(F.sum("n").alias("n"))
    whole = counts.groupBy("feature").agg(F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by"))
    top = whole.orderBy(F.col("feature").startswith("@").desc(), F.col("total").desc(), "feature").limit(max_features)
    top = top.select("feature", F.map_keys("by").alias("langs"), F.map_values("by").alias("n")).toArrow()
    feature, of_lang, n = top.column("feature").to_pylist(), top.column("langs").combine_chunks(), top.column("n").combine_chunks()
    langs = sorted(of_lang.flatten().unique().to_pylist())
    if not langs:
        return Model([], {}, np.zeros((1, 0), np.float32), {})
    matrix = np.zeros((len(feature), len(langs)))
    row = np.repeat(np.arange(len(feature)), of_lang.value_lengths().to_numpy())
    matrix[row, pa.compute.index_in(of_lang.flatten(), pa.array(langs)).to_numpy()] = n.flatten().to_numpy()
    n_scripts = sum(f[0] == "@" for f in feature)  # first in the order
    in_script = {f[1:]: matrix[i] for i, f in enumerate(feature[:n_scripts])}
    words = sum(in_script.values())
    names, counts = feature[n_scripts:], matrix[n_scripts:]
    logs = np.log((np.vstack([counts, np.zeros(len(langs))]) + 0.5) / (counts.sum(0) + 0.5 * (len(names) + 1))).astype(np.float32)
    scripts = {s: n >= LEAST_SHARE * words for s, n in in_script.items()}
    return Model(langs, dict(zip(names, range(len(names)), strict=True)), logs, {s: x for s, x in scripts.items() if x.any()})


def _alone(scores: list[list[float]], value: list[float], switch: float) -> tuple[list[int], int]:
    """(labels, label before) of the rows of one text that go on from value."""
    back = []
    for s in scores:
        best = value.index(max(value))
        bound = value[best] - switch
        back.append([k if v >= bound else best for k, v in enumerate(value)])
        value = [(v if v >= bound else bound) + x for v, x in zip(value, s)]
    at, label = value.index(max(value)), []
    for came in reversed(back):
        label.append(at)
        at = came[at]
    return label[::-1], at


def viterbi(scores: np.ndarray, sizes: np.ndarray, switch: float) -> np.ndarray:
    """Labels of the rows of scores (words of texts of those sizes, one text after the other): best paths where each change
    costs `switch`. All texts move on by one word at a step, the longest first, so that a step is one array operation; when
    only FEW go on, each goes its way alone."""
    order = np.argsort(-sizes, kind="stable")
    starts, ends = (np.cumsum(sizes) - sizes)[order], np.cumsum(sizes)[order]
    longest = int(sizes.max(initial=0))
    #: texts that have a word at each step
    active = np.searchsorted(-sizes[order], -np.arange(longest), side="left")
    stay = np.empty(scores.shape, bool)
    came = np.empty(len(scores), np.int16)
    value = np.zeros((len(order), scores.shape[1]), np.float32)
    together = int(np.searchsorted(-active, -FEW))
    for t in range(together):
        n = active[t]
        rows, v = starts[:n] + t, value[:n]
        best = v.argmax(1)
        bound = np.take_along_axis(v, best[:, None], 1) - switch
        kept = v >= bound
        stay[rows], came[rows] = kept, best
        value[:n] = np.where(kept, v, bound) + scores[rows]
    label = np.empty(len(scores), np.int16)
    now = value.argmax(1)
    for i in range(active[together] if together < longest else 0):
        rows = slice(starts[i] + together, ends[i])
        label[rows], now[i] = _alone(scores[rows].tolist(), value[i].tolist(), switch)
    for t in range(together - 1, -1, -1):
        n = active[t]
        rows, at = starts[:n] + t, now[:n]
        label[rows] = at
        now[:n] = np.where(stay[rows, at], at, came[rows])
    return label


def spans_of(label: np.ndarray) -> list[tuple[int, int, int]]:
    """Runs of equal labels: (start, length, label)."""
    if not len(label):
        return []
    at = np.flatnonzero(np.r_[True, label[1:] != label[:-1]])
    return list(zip(at.tolist(), np.diff(np.r_[at, len(label)]).tolist(), label[at].tolist(), strict=True))


@dataclass
class Verdict:
    lang: str = UNKNOWN
    #: share of the words with letters in the language, and how clearly they, and all, beat the other languages by the word
    share: float = 0.0
    clear: float = 0.0
    all_clear: float = 0.0
    spans: list[tuple[int, int, int]] = field(default_factory=list)


def _logistic(margins: np.ndarray) -> float:
    return 1 / (1 + math.exp(-min(max(float(margins.mean()) / 2, -30), 30)))


def judged(texts: pa.Array, scores_of: Scorer, switch: float) -> Iterator[list[Verdict]]:
    """Verdicts on texts, a few texts at a time."""
    model, n_langs = scores_of.model, max(len(scores_of.model.langs), 1)

    def chunk(tokens: list[list[str]]) -> list[Verdict]:
        rows = scores_of.rows(tokens)
        sizes = np.array([len(x) for x in rows], np.int64)
        flat = np.concatenate([*rows, np.zeros(0, np.int64)])
        scores, has = scores_of.table[flat], scores_of.lettered[flat]
        label = viterbi(scores, sizes, switch)
        out = []
        for end, n in zip(np.cumsum(sizes), sizes, strict=True):
            part = slice(end - n, end)
            words = has[part]
            if not model.langs or not words.any():
                out.append(Verdict())
                continue
            mine, by_lang = label[part][words], scores[part][words]
            best = int(np.bincount(mine, minlength=n_langs).argmax())
            own = by_lang[np.arange(len(mine)), mine]
            by_lang[np.arange(len(mine)), mine] = -np.inf
            margin = own - by_lang.max(1) if n_langs > 1 else np.full(len(own), 10.0)
            out.append(Verdict(model.langs[best], float((mine == best).mean()), _logistic(margin[mine == best]), _logistic(margin), spans_of(label[part])))
        return out

    chars = n = 0
    tokens: list[list[str]] = []
    for text in texts:  # one at a time: a batch's texts aren't all held as Python strings
        whole = text.as_py() or ""
        tokens.append(whole.split())
        n += len(tokens[-1])
        chars += len(whole)
        if n * n_langs >= CHUNK or chars >= CHARS:
            yield chunk(tokens)
            tokens, chars, n = [], 0, 0
    if tokens:
        yield chunk(tokens)


def identify(docs: DataFrame, model: Model, switch: float = SWITCH, max_cache: int = MAX_CACHE) -> DataFrame:
    """docs (doc_id, text) with lang_pred, score and spans: array of (start, len, lang) in words cut at white space.

    lang_pred has most of the words with letters; score is their share, times how clearly they beat the other
    languages by the word (a logistic of half the mean margin). A null text, or one without letters, is "und" with score 0 and no span.
    Ties go to the earlier language. Repeated rows are judged each, null ids too; an empty table gives no row; other
    columns are ignored. Distinct tokens are scored once, in a cache that is dropped at max_cache tokens.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    kind = pa.list_(pa.struct([("start", pa.int64()), ("len", pa.int64()), ("lang", pa.string())]))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        scores_of = Scorer(model, max_cache)
        for batch in batches:
            first = 0
            for found in judged(batch.column(1), scores_of, switch):
                ids, first = batch.column(0).slice(first, len(found)), first + len(found)
                spans = [[{"start": s, "len": z, "lang": model.langs[k]} for s, z, k in v.spans] for v in found]
                yield pa.RecordBatch.from_arrays([ids, pa.array([v.lang for v in found], pa.string()), pa.array([v.share * v.clear for v in found], pa.float64()), pa.array(spans, kind)], ["doc_id", "lang_pred", "score", "spans"])

    return docs.select("doc_id", "text").mapInArrow(predict, f"doc_id {id_type}, lang_pred string, score double, spans array<struct<start:bigint,len:bigint,lang:string>>")


def training(docs: DataFrame, folds: int = 5) -> DataFrame:
    """The rows a model may learn from: those whose crc32 of doc_id as text isn't 0 modulo folds."""
    return docs.where(crc_mod("doc_id", folds) != 0).select("doc_id", "text", "lang")


def keep_identified(docs: DataFrame, model: Model, least: float = 0.5, switch: float = SWITCH) -> DataFrame:
    """docs without those of no language (null texts, no letters) and those whose words, each in its span's language, beat
    the other languages with no more clearness than `least`, however many languages a text mixes. Rows pass through
    once, and what is kept keeps all its columns, whatever their names; repeated rows and null ids are judged each."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores_of = Scorer(shipped.value, MAX_CACHE)
        for batch in batches:
            first = 0
            for found in judged(batch.column(at), scores_of, switch):
                good = [v.lang != UNKNOWN and v.all_clear > least for v in found]
                yield batch.slice(first, len(found)).filter(pa.array(good, pa.bool_()))
                first += len(found)

    return docs.mapInArrow(keep, docs.schema)


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    """Languages of all texts by a model of the documents that aren't held out. Nulls, repeated rows and empty tables: see
    identify."""
    docs = documents(spark, sf_dir)
    found = identify(docs, fit(training(docs)))
    return found.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))
