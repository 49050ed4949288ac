import random

import pytest
from railtide.llm import reading_level as R

PLAIN = "cat dog sun bread ball rain tree milk hand road hill boat".split()
COMMON = "teacher market engine station weather village doctor picture".split()
HARDER = "hypothesis parameter estimate framework correlation mechanism".split()
RESEARCH = "cohomology hypersurface ergodicity semigroup functional manifold".split()
KINDS = {1: (PLAIN, 7), 2: (COMMON, 13), 3: (HARDER, 18), 4: (RESEARCH, 26)}


def sentence(level, r):
    vocabulary, n = KINDS[level]
    return " ".join(["the" if k % 3 == 0 else r.choice(vocabulary) for k in range(n + r.randrange(-2, 3))]).capitalize() + "."


def document(level, seed, n=14, other=None):
    r = random.Random(seed)
    return "\n".join(sentence(level if r.random() < 0.8 else other or r.randrange(1, 5), r) for _ in range(n))


def test_prose():
    text = r"""\documentclass{article}
\newcommand{\thex}{the} \newcommand{\hl}[1]{\textbf{#1}}
\title{Not prose}
\begin{document}\maketitle
% a comment with words
The cat \hl{sat} on \thex{} mat~\cite{k1} (see Fig.~\ref{f}). It was 5\% warm $x^2 + y$ today!
\section{Heading words}
New part
goes on. \begin{equation} a = b \end{equation} After it.
\iffalse hidden words \fi
\begin{comment} more hidden \end{comment}

Last without stop
\begin{thebibliography}{9}
\bibitem{a} Book words.
"""
    assert R.prose(text).split("\n") == ["the cat sat on the mat see fig", "it was warm today", "new part goes on", "after it", "last without stop"]
    assert R.prose("A coef-\n\ufb01cient of\u00a0this.") == "a coefficient of this"
    assert R.prose("Plain text. Two sentences.\r\nThird one") == "plain text\ntwo sentences\nthird one"
    assert R.prose(None) == R.prose("") == R.prose("% only a comment") == ""


@pytest.fixture(scope="module")
def corpus():
    docs = [(i, document(i % 4 + 1, i), ["en", None, "EN-gb", "en"][i // 4 % 4]) for i in range(400)]
    labels = [(i, r, (i % 4 + 1) if (i + k) % 17 else 1 + (i + k) % 4) for i in range(0, 160) for k, r in enumerate(("a", "b"))] + [(5, "c", None), (9999, "a", 3)]
    return docs, labels


def test_held_out_accuracy(spark, corpus):
    docs, labels = corpus
    extra = [(1000, document(1, 1), "de"), (1001, "Too short.", "en"), (1002, None, "en"), (1003, "", None), (1004, document(4, 3), " eng"),
             (1005, document(2, 5) + "\n% " + document(4, 6, 60).replace("\n", "\n% "), "en"), (0, docs[0][1], "en"), (None, docs[3][1], "en")]
    d = spark.createDataFrame(docs + extra, "doc_id long, text string, lang string").selectExpr("*", "1 AS reading_level", "'w' AS word")
    lab = spark.createDataFrame(labels, "doc_id long, rater string, reading_level int")
    got = R.reading_levels(d, lab).collect()
    by = {r["doc_id"]: r["reading_level"] for r in got}
    assert len(got) == len(docs) + 4 and not {1000, 1001, 1002, 1003} & set(by)
    held_out = [i for i, *_ in docs if i >= 160]
    assert sum(by[i] == i % 4 + 1 for i in held_out) >= 0.95 * len(held_out)
    assert by[1004] == 4 and by[1005] == 2 and by[None] == 4
    spread = {x: sum(r["unfamiliar"] for r in got if r["doc_id"] in held_out and r["reading_level"] == x) for x in (1, 4)}
    assert spread[1] < spread[4]


def test_empty_and_without_labels(spark, corpus):
    d = spark.createDataFrame(corpus[0][:8], "doc_id long, text string, lang string")
    lab = spark.createDataFrame(corpus[1], "doc_id long, rater string, reading_level int")
    assert R.reading_levels(d.limit(0), lab).count() == 0
    assert {r["reading_level"] for r in R.reading_levels(d, lab.limit(0)).collect()} == {1}
