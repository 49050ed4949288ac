"""Reading level of each document: familiar-word lists and average sentence length.

The plain formula takes one list of frequent words, the share of words outside it, and the average sentence length. Here
plain words aren't the most frequent ones (research terms stand in almost as many documents), so there is a list for
every step of ``STEP`` in document frequency, taken from all English documents, and the share of a sentence's words in
each list has a weight per grade 1 to 4. Weights come from rated documents: the shares of the lists in the sentences of a
grade, refined by sentence, since a document may hold prose of several grades. A document's sentences are grouped by
grade; each group has a level by its grade and its average sentence length; and the document has the level that holds
most of its words. Weights and length bounds are fitted on a bounded sample of rated documents; everything else, the
lists included, covers all documents and whole texts. No word counts by itself, only its document frequency does.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railtide.llm.texts import whole_words
from railtide.session import cut

LEVELS = 4
MIN_WORDS = 60
#: A word is frequent if it stands in at least this share of the English documents.
MIN_SHARE = 0.002
#: Width of a list in 2 asin(sqrt(document frequency)), a scale on which counts of all frequencies scatter alike.
STEP = 0.05
#: Most rated documents that the grades are fitted on, in the order of a hash of their ids.
MAX_RATED = 2000
ROUNDS = 6

_COMMENT = re.compile(r"(?<!\\)%[^\n]*")
_OFF = re.compile(r"\\iffalse\b.*?(?:\\fi\b|\Z)", re.S)
_APART = ("equation", "eqnarray", "align", "gather", "multline", "displaymath", "math", "array", "tabular", "table", "figure",
          "thebibliography", "verbatim", "lstlisting", "comment")
_ENV = re.compile(r"\\begin\{(" + "|".join(_APART) + r")(\*?)\}.*?(?:\\end\{\1\2\}|\Z)", re.S)
_MATH = re.compile(r"\$\$.*?\$\$|(?<!\\)\$[^$]*\$|\\\[.*?\\\]|\\\(.*?\\\)", re.S)
_ARGS = r"\*?(?:\s*\[[^\]]*\])?(?:\{(?:[^{}]|\{[^{}]*\})*\})*"
_HEADING = re.compile(r"\\(?:title|author|date|(?:sub)*section|(?:sub)?paragraph|chapter|part|caption|begin|end|maketitle|item)(?![A-Za-z])" + _ARGS)
_SILENT = re.compile(
    r"\\(?:documentclass|usepackage|input|include|bibliography|bibliographystyle|label|cite[a-z]*|ref|eqref|pageref|"
    r"DeclareMathOperator|includegraphics|url|href)(?![A-Za-z])" + _ARGS)
_DEFINE = re.compile(r"\\(?:re|provide)?newcommand\*?\{?(\\[A-Za-z]+)\}?(?:\[[^\]]*\])*\{((?:[^{}]|\{[^{}]*\})*)\}|\\def(\\[A-Za-z]+)[^{\n]*\{((?:[^{}]|\{[^{}]*\})*)\}")
_WORDS = re.compile(r"[A-Za-z][A-Za-z ]*")
_COMMAND = re.compile(r"\\[A-Za-z@]+\*?")
_STOP = re.compile(r"[.!?]+(?=\s|\Z|['\")}])|\n[ \t]*\n\s*")
_KEEP = bytes(c if 97 <= c <= 122 or c in (10, 128) or c > 128 else 32 for c in range(256))


def prose(text: str | None) -> str:
    """Running prose in lower case: words with single blanks, one sentence a line. Markup, comments, formulas, tables,
    headings and bibliography are left out; macros that stand for plain words are written out. A cut-off environment
    ends with the text."""
    if not text:
        return ""
    t = whole_words(text)
    if "\\" in t or "%" in t or "$" in t:
        t = _COMMENT.sub("", t)
        macros = {}
        if "\\newcommand" in t or "\\def" in t:
            for a, b, c, d in _DEFINE.findall(t):
                if _WORDS.fullmatch(b or d):
                    macros[a or c] = b or d
            t = _DEFINE.sub(" ", t)
        head = t.find("\\begin{document}")
        if head >= 0:
            t = t[head + 16 :]
        tail = t.find("\\end{document}")
        if tail >= 0:
            t = t[:tail]
        if "\\iffalse" in t:
            t = _OFF.sub(" ", t)
        t = _ENV.sub("\n\n", t) if "\\begin" in t else t
        t = _MATH.sub(" ", t)
        t = _HEADING.sub("\n\n", t)
        t = _SILENT.sub(" ", t)
        if macros:
            t = _COMMAND.sub(lambda m: macros.get(m[0], " "), t)
        else:
            t = _COMMAND.sub(" ", t)
    t = _STOP.sub("\x00", t)
    # sentence ends become line breaks once the text's own are gone
    b = t.lower().replace("\n", " ").replace("\x00", "\n").encode("utf-8", "replace").translate(_KEEP)
    return b"\n".join(s for x in b.split(b"\n") if (s := b" ".join(x.split()))).decode("utf-8", "ignore")


@dataclass
class Grades:
    """The fitted formula: the list that each frequent word is in, a weight of each list per grade, and length bounds."""

    words: dict[str, int]
    logp: np.ndarray
    #: per grade (bound, level up to it, level beyond it) on the average sentence length
    bounds: list[tuple[float, int, int]]


def familiar_lists(counts: dict[str, int], total: int) -> dict[str, int]:
    """The list of each word, numbered from the rarest words up, from the documents that have it of ``total``."""
    step = {w: int(2 * np.arcsin(np.sqrt(min(1.0, n / total))) / STEP) for w, n in counts.items()}
    number = {x: k for k, x in enumerate(sorted(set(step.values())))}
    return {w: number[x] for w, x in step.items()}


def _groups(lines: list[list[str]], words: dict[str, int], logp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words per grade, and average sentence length per grade, of one document's sentences."""
    lengths = np.array([len(s) for s in lines])
    ids = np.array([words.get(w, -1) for s in lines for w in s])
    p = np.where((ids >= 0)[None, :], logp[:, ids], 0.0)
    grade = np.add.reduceat(p, np.r_[0, lengths.cumsum()[:-1]], axis=1).argmax(0)
    held = np.bincount(grade, weights=lengths, minlength=LEVELS)
    count = np.bincount(grade, minlength=LEVELS)
    return held, held / np.maximum(count, 1)


def _level(held: np.ndarray, average: np.ndarray, bounds: list[tuple[float, int, int]]) -> int:
    by = np.zeros(LEVELS + 1)
    for g in range(LEVELS):
        if held[g]:
            at, low, high = bounds[g]
            by[low if average[g] <= at else high] += held[g]
    return int(by[1:].argmax()) + 1


def _split(text: str) -> list[list[str]]:
    return [s.split() for s in text.split("\n") if s]


def fit(rated: list[tuple[str, int]], words: dict[str, int], rounds: int = ROUNDS) -> Grades:
    """Weights and bounds from (prose, level) pairs and the lists; without any pair, every document is at level 1."""
    docs = [(lines, y) for text, y in rated if (lines := _split(text))]
    size = max(words.values(), default=-1) + 1
    if not docs or not size:
        return Grades({}, np.zeros((LEVELS, 1)), [(0.0, 1, 1)] * LEVELS)
    lines, owner = [], []
    for d, (ls, _) in enumerate(docs):
        for s in ls:
            lines.append(np.array([words[w] for w in s if w in words], np.int64))
            owner.append(d)
    prior = np.full((len(docs), LEVELS), 0.1)
    prior[np.arange(len(docs)), [y - 1 for _, y in docs]] = 0.7
    at = prior[owner]
    flat = np.concatenate([*lines, np.empty(0, np.int64)])
    sizes = np.array([len(x) for x in lines])
    row = np.repeat(np.arange(len(lines)), sizes)
    for _ in range(rounds):
        counts = np.stack([np.bincount(flat, weights=at[row, g], minlength=size) for g in range(LEVELS)]) + 0.05
        logp = np.log(counts / counts.sum(1, keepdims=True))
        score = np.stack([np.bincount(row, weights=logp[g, flat], minlength=len(lines)) for g in range(LEVELS)], 1) + np.log(prior[owner])
        at = np.exp(score - score.max(1, keepdims=True))
        at /= at.sum(1, keepdims=True)
    logp = np.c_[logp, np.zeros(LEVELS)]  # column -1 is for words in no list
    seen = [(*_groups(ls, words, logp), y) for ls, y in docs]
    bounds = []
    for g in range(LEVELS):
        own = sorted((float(average[g]), y) for held, average, y in seen if held.argmax() == g)
        best = (len(own) + 1, 0.0, g + 1, g + 1)
        cuts = [0.0] + [(a[0] + b[0]) / 2 for a, b in zip(own, own[1:]) if a[0] < b[0]]
        for c in cuts:
            below, above = [y for v, y in own if v <= c], [y for v, y in own if v > c]
            # smoothing towards one level: a bound must save more than one document
            low, high = (Counter(x).most_common(1)[0][0] if x else None for x in (below, above))
            low, high = low or high or g + 1, high or low or g + 1
            if low <= high:
                wrong = sum(y != low for y in below) + sum(y != high for y in above) + (1 if low != high else 0)
                if wrong < best[0]:
                    best = (wrong, c, low, high)
        bounds.append(best[1:])
    return Grades(words, logp, bounds)


def prose_and_frequencies(documents: DataFrame, doc_id: str, text: str, lang: str) -> DataFrame:
    """One pass over all English documents: rows (doc_id, prose) and, per task, rows (word, documents with it)."""
    english = documents.where(F.col(lang).isNull() | F.lower(F.trim(lang)).startswith("en"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "prose", "word", "n"]
        seen: Counter[str] = Counter()
        for b in batches:
            ids, texts = b.column(0), [prose(t.as_py()) for t in b.column(1)]
            for t in texts:
                seen.update(set(t.split()))
            n = len(texts)
            yield pa.RecordBatch.from_arrays([ids, pa.array(texts, pa.string()), pa.nulls(n, pa.string()), pa.nulls(n, pa.int64())], names)
            if len(seen) > 500_000:
                yield _counts(seen, names)
                seen = Counter()
        yield _counts(seen, names)

    return english.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, prose string, word string, n long")


def _counts(seen: Counter, names: list[str]) -> pa.RecordBatch:
    k = len(seen)
    return pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64()), pa.nulls(k, pa.string()), pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names)


def reading_levels(documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
                   min_words: int = MIN_WORDS, min_share: float = MIN_SHARE, max_rated: int = MAX_RATED) -> DataFrame:
    """(doc_id, reading_level, words, sentence_length, unfamiliar): every English document with enough prose.

    English is a null language or one that begins with ``en``. Null and empty texts, and texts with fewer than
    min_words words of prose, have no row; a repeated document row gives its row again. ``unfamiliar`` is the share of
    words outside the lists that weigh most for the plainest grade. Null levels and raters' rows for unknown documents are ignored; of
    disagreeing raters the lower median counts, and levels other than 1 to 4 are no ratings. Other columns are ignored; empty documents give no rows, and without
    labels every document gets level 1.
    """
    done = cut(prose_and_frequencies(documents, doc_id, text, lang))
    docs = done.where("word is null").select("doc_id", "prose")
    total = docs.count()
    # bounded whatever the corpus: at most (mean distinct words of a document) / min_share words are this frequent
    frequent = {r["word"]: r["n"] for r in done.where("word is not null").groupBy("word").agg(F.sum("n").alias("n"))
                .where(F.col("n") >= max(2, min_share * total)).toLocalIterator()}
    # counts per level, not lists: the lower median is the first level that half of the raters don't exceed
    level, upto, half = F.lit(LEVELS), F.lit(0), F.ceil(F.count("*") / 2)
    votes = labels.where(F.col("reading_level").between(1, LEVELS) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    steps = []
    for k in range(1, LEVELS):
        upto = upto + F.count_if(F.col("reading_level") == k)
        steps.append((upto >= half, k))
    for reached, k in reversed(steps):
        level = F.when(reached, k).otherwise(level)
    rated = votes.agg(level.alias("level")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rated)
    known = docs.join(F.broadcast(rated), "doc_id").groupBy("doc_id", "level").agg(F.min("prose").alias("prose"))
    model = fit([(r["prose"], r["level"]) for r in known.orderBy("doc_id").toLocalIterator()], familiar_lists(frequent, total))
    return docs.mapInArrow(_scorer(model, min_words), "doc_id long, reading_level int, words int, sentence_length double, unfamiliar double")


def _scorer(model: Grades, min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = {w for w, k in model.words.items() if model.logp[:, k].argmax() == 0}
        for b in batches:
            out = []
            for d, t in zip(b.column(0).to_pylist(), b.column(1)):
                lines = _split(t.as_py())
                n = sum(map(len, lines))
                if n < min_words or not n:
                    continue
                held, average = _groups(lines, model.words, model.logp)
                hard = sum(w not in plain for s in lines for w in s)
                out.append((d, _level(held, average, model.bounds), n, n / len(lines), hard / n))
            cols = list(zip(*out)) or [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "reading_level", "words", "sentence_length", "unfamiliar"])

    return run
