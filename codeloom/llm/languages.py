"""Language identification: script ranges, word scores, and Viterbi labels of spans."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from codeloom.llm.storage import gathered_rows, give_back, held_out, summed
from codeloom.llm.words import lowered, slices, texts_of

GRAMS = 1 << 16   # hashed byte trigrams of words
MAX_LANGUAGES = 256
SWITCH = 12.0     # what a change of language costs, in nats
BARRED = 30.0     # what a word in a script that a language doesn't use costs it

# First code points of Unicode script ranges, and the scripts. Letters before the first and between named ranges: "other".
SCRIPTS = ["latin", "greek", "cyrillic", "armenian", "hebrew", "arabic", "indic", "thai", "lao", "tibetan", "myanmar", "georgian",
           "hangul", "ethiopic", "khmer", "kana", "han", "other"]
RANGES = [(0x0000, "latin"), (0x0250, "other"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
          (0x0600, "arabic"), (0x0780, "other"), (0x0900, "indic"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"),
          (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "other"), (0x1780, "khmer"),
          (0x1800, "other"), (0x1C80, "cyrillic"), (0x1C90, "georgian"), (0x1CC0, "other"), (0x1E00, "latin"), (0x1F00, "greek"),
          (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"), (0x2D00, "georgian"), (0x2D30, "other"), (0x2DE0, "cyrillic"),
          (0x2E00, "other"), (0x2E80, "han"), (0x3040, "kana"), (0x3100, "han"), (0x3130, "hangul"), (0x3190, "han"), (0x31F0, "kana"),
          (0x3200, "other"), (0x3400, "han"), (0xA000, "other"), (0xA640, "cyrillic"), (0xA6A0, "other"), (0xA720, "latin"),
          (0xA800, "other"), (0xAC00, "hangul"), (0xD800, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB13, "armenian"),
          (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE00, "other"), (0xFF21, "latin"), (0xFF66, "kana"), (0xFFA0, "hangul"),
          (0xFFE0, "other"), (0x20000, "han"), (0x32000, "other")]


def letters() -> np.ndarray:
    """Bytes of lowered words: a-z and all of non-ASCII."""
    keep = np.zeros(256, bool)
    keep[97:123] = keep[128:] = True
    return keep


class Spelled:
    """Words of a slice: byte ranges, the trigrams ending at each byte, scripts, and the first word of each row (one more than rows)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        body, base = lowered()[data[offsets[0]: offsets[-1]]], offsets - offsets[0]
        keep = letters()[body]
        begin = keep.copy()
        begin[1:] &= ~keep[:-1]
        rows = base[1:-1][(base[1:-1] > 0) & (base[1:-1] < len(body))]
        begin[rows] = keep[rows]   # a word starts where its row does
        finish = keep.copy()
        finish[:-1] &= ~keep[1:] | begin[1:]
        self.start, self.end = np.flatnonzero(begin), np.flatnonzero(finish) + 1
        self.first = np.searchsorted(self.start, base)
        self.base = base
        wide = body.astype(np.uint32)
        before, after = np.zeros_like(wide), np.zeros_like(wide)
        before[1:], after[:-1] = wide[:-1], wide[1:]
        before[begin] = after[finish] = 0
        code = ((before << np.uint32(16)) | (wide << np.uint32(8)) | after) * np.uint32(0x9E3779B1)
        self.keep, self.grams = keep, (code >> np.uint32(16)).astype(np.int32)
        characters = np.concatenate([[0], np.cumsum(body & 0xC0 != 0x80)])
        self.letters = characters[self.end] - characters[self.start]
        # code point of a word's first character
        padded = np.concatenate([body, np.zeros(3, np.uint8)])
        lead, b1, b2, b3 = (padded[self.start + i].astype(np.int32) for i in range(4))
        two = (lead & 31) << 6 | b1 & 63
        three = (lead & 15) << 12 | (b1 & 63) << 6 | b2 & 63
        four = (lead & 7) << 18 | (b1 & 63) << 12 | (b2 & 63) << 6 | b3 & 63
        point = np.where(lead < 128, lead, np.where(lead < 224, two, np.where(lead < 240, three, four)))
        bounds = np.array([r[0] for r in RANGES])
        kinds = np.array([SCRIPTS.index(r[1]) for r in RANGES])
        self.script = kinds[np.searchsorted(bounds, point, "right") - 1]


def gatherer(names: list[str]):
    """Counts of trigrams and of words by script for each language: arrays of ``GRAMS + len(SCRIPTS)`` numbers, under its index."""
    index = {name: i for i, name in enumerate(names)}

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            data, offsets = texts_of(batch.column(1))
            langs = np.array([index[x] for x in batch.column(0).to_pylist()])
            for first, last in slices(offsets):
                spelled = Spelled(data, offsets[first: last + 1])
                row = np.searchsorted(spelled.base, np.flatnonzero(spelled.keep), "right") - 1
                of_gram, of_word = langs[first + row], np.repeat(langs[first:last], np.diff(spelled.first))
                for lang in np.unique(of_gram):
                    total = sums.setdefault(int(lang), np.zeros(GRAMS + len(SCRIPTS), np.int64))
                    total[:GRAMS] += np.bincount(spelled.grams[spelled.keep][of_gram == lang], minlength=GRAMS)
                    total[GRAMS:] += np.bincount(spelled.script[of_word == lang], minlength=len(SCRIPTS))
        yield from gathered_rows(sums)
    return run


def fit(docs: DataFrame, per_language: int = 4000, id: str = "doc_id", text: str = "text", lang: str = "lang") -> dict:
    """``languages``, ``scores`` (log shares of trigrams, one column per language) and ``barred`` (scripts x languages).

    Learned from about ``per_language`` documents of each language of the training fold, drawn by hash, and from all if there are fewer. More
    than ``MAX_LANGUAGES`` values are an error: a table of their scores would not be small, and none is left out silently.
    """
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & ~held_out(id))
    counts = known.groupBy(F.col(lang).alias("lang")).count().limit(MAX_LANGUAGES + 1).collect()
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages to learn")
    names = sorted(r["lang"] for r in counts)
    if not names:
        return {"languages": [], "scores": np.zeros((GRAMS, 0), np.float32), "barred": np.zeros((len(SCRIPTS), 0), np.float32)}
    limit = F.lit(-1)
    for r in counts:
        limit = F.when(F.col(lang) == r["lang"], min(1_000_000, per_language * 1_000_000 // r["count"] + 1)).otherwise(limit)
    drawn = known.where(F.pmod(F.xxhash64(id, text), F.lit(1_000_000)) < limit).select(lang, text)
    rows = drawn.mapInArrow(gatherer(names), "key int, chunk int, counts binary")
    sums = summed(rows, len(names), GRAMS + len(SCRIPTS)).astype(float).T
    grams, scripts = sums[:GRAMS] + 0.5, sums[GRAMS:]
    shares = scripts / np.maximum(scripts.sum(axis=0), 1)
    barred = shares < 0.001
    barred[barred.all(axis=1)] = False   # a script that no language is known to use narrows nothing
    return {"languages": names, "scores": np.log(grams / grams.sum(axis=0)).astype(np.float32), "barred": (barred * BARRED).astype(np.float32)}


def viterbi(scores: np.ndarray, switch: float) -> np.ndarray:
    """The best language of each word of a text when each change of language costs ``switch``; of equal ones the first."""
    words, languages = scores.shape
    back = np.empty((words, languages), np.int32)
    best, own = np.zeros(languages), np.arange(languages)
    for t in range(words):
        top = int(best.argmax())
        change = best[top] - switch > best
        back[t] = np.where(change, top, own)
        best = np.where(change, best[top] - switch, best) + scores[t]
    path = np.empty(words, np.int32)
    at = int(best.argmax())
    for t in range(words - 1, -1, -1):
        path[t] = at
        at = back[t, at]
    return path


def label_words(scores: np.ndarray, first: np.ndarray, switch: float) -> np.ndarray:
    """Viterbi labels of all rows' words. A row in which no language gains more than half of ``switch`` over the row's best one in any
    stretch has that one throughout (n stretches of others cost n - 1 changes at least, and a single one over the whole row gains nothing);
    only the other rows are traced word by word."""
    rows, lengths = len(first) - 1, np.diff(first)
    row = np.repeat(np.arange(rows), lengths)
    sums = np.concatenate([np.zeros((1, scores.shape[1])), np.cumsum(scores, axis=0, dtype=np.float64)])
    best = (sums[first[1:]] - sums[first[:-1]]).argmax(axis=1)
    path = best[row].astype(np.int32)
    gain = np.zeros(rows)
    word = np.arange(len(scores))
    heads = first[:-1] + np.arange(rows)   # one place before the words of each row
    for k in range(scores.shape[1]):
        more = scores[:, k].astype(np.float64) - scores[word, path]
        # a fall before each row, larger than all rises: a running minimum starts anew there
        steps = np.full(len(scores) + rows, -1.0 - np.maximum(more, 0).sum())
        steps[word + row + 1] = more
        height = np.cumsum(steps)
        gain = np.maximum(gain, np.maximum.reduceat(height - np.minimum.accumulate(height), heads))
    for r in np.flatnonzero(gain > switch / 2 - 1e-6):
        path[first[r]: first[r + 1]] = viterbi(scores[first[r]: first[r + 1]].astype(np.float64), switch)
    return path


def labeller(model, text: int, switch: float, added: list[str]):
    def run(batches):
        names, table, barred = model.value["languages"], model.value["scores"], model.value["barred"]
        kinds = [pa.string(), pa.float64(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))]
        for batch in batches:
            data, offsets = texts_of(batch.column(text))
            predicted: list = [None] * batch.num_rows
            score = np.zeros(batch.num_rows)
            spans: list = [[]] * batch.num_rows
            for first, last in slices(offsets) if names else ():
                spelled = Spelled(data, offsets[first: last + 1])
                if not len(spelled.start):
                    continue
                size = spelled.end - spelled.start
                scores = np.add.reduceat(table[spelled.grams[spelled.keep]], np.cumsum(size) - size, axis=0) - barred[spelled.script]
                path = label_words(scores, spelled.first, switch)
                owner = np.repeat(np.arange(last - first), np.diff(spelled.first))
                share = np.bincount(owner * len(names) + path, spelled.letters, (last - first) * len(names)).reshape(-1, len(names))
                top = share.argmax(axis=1)
                new = np.ones(len(path), bool)
                new[1:] = (path[1:] != path[:-1]) | (owner[1:] != owner[:-1])
                heads = np.flatnonzero(new)
                tails = np.append(heads[1:], len(path)) - 1
                for r, a, b, lang in zip(owner[heads], spelled.start[heads], spelled.end[tails], path[heads]):
                    if not spans[first + r]:
                        spans[first + r] = []
                    spans[first + r].append({"start": int(a - spelled.base[r]), "end": int(b - spelled.base[r]), "lang": names[lang]})
                for r in np.flatnonzero(np.diff(spelled.first)):
                    predicted[first + r] = names[top[r]]
                    score[first + r] = share[r, top[r]] / share[r].sum()
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x, k) for x, k in zip((predicted, score, spans), kinds))],
                                             [*batch.schema.names, *added])
            del predicted, score, spans
            give_back()
    return run


def identify_languages(docs: DataFrame, train: DataFrame | None = None, switch: float = SWITCH, id: str = "doc_id", text: str = "text", lang: str = "lang",
                       per_language: int = 4000, prefix: str = "__") -> DataFrame:
    """The columns of ``docs`` and ``__lang``, ``__score`` (share of the text's letters that are in spans of this language) and ``__spans`` (byte ranges, each with
    its language).

    A word's script, by the range of its first letter, bars languages that hardly use it; its trigrams of bytes score the others; Viterbi labels the words of a whole
    text with a cost for each change of language. The language with most letters is the text's. The model is learned from ``train`` (default: ``docs``) and
    broadcast: at most ``MAX_LANGUAGES`` columns. Documents aren't moved.

    A text that is null or has no letter is ``und`` with score 0 and no spans, and so are all if nothing could be learned. Ids of the evaluation fold are never
    learned from; only the text is an input of a prediction. Equal shares give the language that sorts first. Repeated rows are kept. ``prefix`` begins the
    names of the new columns; columns of ``docs`` with those names are replaced. Very long texts are labelled whole, a text a slice; no rows give no rows. More than
    ``MAX_LANGUAGES`` distinct languages in ``train`` raise an error.
    """
    train = docs if train is None else train
    model = docs.sparkSession.sparkContext.broadcast(fit(train, per_language, id, text, lang))
    added = [prefix + name for name in ("lang", "score", "spans")]
    docs = docs.drop(*added)
    schema = ", ".join(f"`{n}` {k}" for n, k in [*docs.dtypes, *zip(added, ("string", "double", "array<struct<start:int,end:int,lang:string>>"))])
    out = docs.mapInArrow(labeller(model, docs.columns.index(text), switch, added), schema)
    lettered = F.coalesce(F.col(text).rlike(r"\p{L}") & F.col(added[0]).isNotNull(), F.lit(False))
    blank = F.lit("und"), F.lit(0.0), F.array()
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], *[F.when(lettered, F.col(c)).otherwise(b).alias(c) for c, b in zip(added, blank)])
