"""Sequential matching of words on a page: labels against ground truth, alignment with scored words, predicted errors.

These walk through a page with state, so they run per page as grouped Arrow functions; a page is a
bounded group. What can be decided by a join (exact lines) is in the same pass, for it changes state.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafwright.functions.similarity import ratio

BINS = 61
ERROR_REGIONS = ("marginalia", "footnote", "page-number", "header", "decoration", "other")


def label_page(lines: list[dict], truth: list[dict]) -> list[list[str]]:
    """Labels of the words of every predicted line (``words``: normal forms) against the true lines.

    True lines have ``words``, ``kind`` and ``para``. Exact marginalia first, then each line goes to the
    most similar paragraph line, then exact matches with any unused line; words of lines that stay
    unmatched are right where they and a neighbour agree with the unused words of their paragraph.
    """
    margin = [t["words"] for t in truth if t["kind"] == "marginalia" and t["words"]]
    matched: dict[int, str] = {}
    done: set[tuple] = set()
    for phrase in margin:
        hit = next((i for i, x in enumerate(lines) if i not in matched and x["words"] == phrase), None)
        if hit is not None:
            matched[hit] = "marginalia"
            done.add(tuple(phrase))
    paragraphs = [(j, t) for j, t in enumerate(truth) if t["kind"] == "paragraph"]
    home: dict[int, object] = {}
    used: set[int] = set()
    known = [(j, " ".join(t["words"])) for j, t in paragraphs if t["words"]]
    shapes = np.array([_shape(t) for _, t in known]).reshape(len(known), BINS)
    for i, x in enumerate(lines):
        if i in matched or not x["words"] or not known:
            continue
        best, at = _most_similar(" ".join(x["words"]), known, shapes)
        if at is not None:
            home[i] = truth[at]["para"]
            if best == 1.0:
                used.add(at)
                matched[i] = "paragraph"
    by_words = {tuple(t["words"]): j for j, t in enumerate(truth)}
    for i, x in enumerate(lines):
        j = by_words.get(tuple(x["words"]))
        if i not in matched and j is not None and j not in used:
            matched[i] = "any"
            used.add(j)
    labels: list[list[str]] = [["correct" if i in matched else "unmatched"] * len(x["words"]) for i, x in enumerate(lines)]
    rest: dict[object, list[str]] = defaultdict(list)
    for j, t in paragraphs:
        if j not in used:
            rest[t["para"]] += t["words"]
    open_phrases = [p for p in margin if tuple(p) not in done]
    for i, x in enumerate(lines):
        if i in matched:
            continue
        _mark_phrases(x["words"], open_phrases, labels[i])
        if i in home:
            _match_words(x["words"], rest[home[i]], labels[i])
        labels[i] = ["error" if v == "unmatched" else v for v in labels[i]]
    return labels


def _shape(text: str) -> np.ndarray:
    """How often characters occur, by bins of their codes."""
    return np.bincount(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32) % BINS, minlength=BINS)


def _most_similar(text: str, known: list[tuple[int, str]], shapes: np.ndarray) -> tuple[float, int | None]:
    """(ratio, number) of the most similar text, the first of equals; none at ratio 0.

    A ratio is at most what the common characters allow, so texts are compared in the order of that
    bound until it falls below the best ratio found.
    """
    own = _shape(text)
    bound = 2.0 * np.minimum(shapes, own).sum(axis=1) / (shapes.sum(axis=1) + own.sum())
    best, at = 0.0, None
    for k in np.argsort(-bound, kind="stable").tolist():
        if bound[k] < best:
            break
        j, other = known[k]
        r = 1.0 if other == text else ratio(text, other)
        if r > best or (r == best and at is not None and j < at):
            best, at = r, j
    return best, at


def _mark_phrases(words: list[str], phrases: list[list[str]], labels: list[str]) -> None:
    for p in phrases:
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p and all(v == "unmatched" for v in labels[i : i + len(p)]):
                labels[i : i + len(p)] = ["error"] * len(p)


def _match_words(words: list[str], reference: list[str], labels: list[str]) -> None:
    taken = [False] * len(reference)
    places = defaultdict(list)
    for j, w in enumerate(reference):
        places[w].append(j)
    last, end = len(words) - 1, len(reference) - 1
    for i, w in enumerate(words):
        if labels[i] != "unmatched":
            continue
        for j in places.get(w, ()):
            if taken[j]:
                continue
            edge = i == 0 or j == 0 or i == last or j == end
            if edge or words[i - 1] == reference[j - 1] or words[i + 1] == reference[j + 1]:
                labels[i], taken[j] = "correct", True
                break


def word_labels(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """``page_id, line_ord, pos, word, label``; both sides: page_id, line_ord, kind, para, words."""
    both = predicted.select("page_id", F.lit(False).alias("real"), "line_ord", "kind", "para", "words").unionByName(truth.select("page_id", F.lit(True).alias("real"), "line_ord", "kind", "para", "words"))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("line_ord")
        rows = [{"ord": o, "kind": k, "para": p, "words": list(w) if w is not None else [], "real": r} for o, k, p, w, r in zip(pdf["line_ord"], pdf["kind"], pdf["para"], pdf["words"], pdf["real"], strict=True)]
        mine = [r for r in rows if not r["real"]]
        made = label_page(mine, [r for r in rows if r["real"]])
        flat = [(r["ord"], i, w, v) for r, vs in zip(mine, made, strict=True) for i, (w, v) in enumerate(zip(r["words"], vs, strict=True))]
        out = pd.DataFrame(flat, columns=["line_ord", "pos", "word", "label"])
        out.insert(0, "page_id", pdf["page_id"].iloc[0])
        return out

    return both.where("page_id is not null").groupBy("page_id").applyInPandas(one, "page_id string, line_ord long, pos long, word string, label string")


def line_classes(labels: DataFrame) -> DataFrame:
    """red with any error, green if all is correct, else orange."""
    g = labels.groupBy("page_id", "line_ord").agg(F.bool_or(F.col("label") == "error").alias("bad"), F.every(F.col("label") == "correct").alias("good"))
    return g.select("page_id", "line_ord", F.when(F.col("bad"), "red").when(F.col("good"), "green").otherwise("orange").alias("line_class"))


def edit_distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def align(words: list[str], scored: list[str]) -> list[int]:
    """For every page word the scored word it belongs to, or -1: one to one, but a divided word takes two."""
    at, out = 0, [-1] * len(words)
    i = 0
    while i < len(words) and at < len(scored):
        out[i] = at
        if words[i].endswith("⸗") and i + 1 < len(words):
            whole = (words[i].rstrip("⸗") + words[i + 1].replace("⸗", "")).lower().translate(str.maketrans("ſʒƶ", "szz", "-"))
            if edit_distance(whole, scored[at].lower()) <= max(1, int(0.3 * len(scored[at]))):
                out[i + 1] = at
                i += 1
        i += 1
        at += 1
    return out


def chunk_alignment(words: DataFrame, scored: DataFrame) -> DataFrame:
    """``word_id, ppl``: perplexities of scored words on page words; words beyond the last scored one have none.

    ``words``: page_id, word_id, region_ord, line_ord, word_ord, text; ``scored``: page_id, pos, word, ppl.
    """

    def one(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left, right = left.sort_values(["region_ord", "line_ord", "word_ord", "word_id"], na_position="first"), right.sort_values("pos")
        places = align([t or "" for t in left["text"]], [t or "" for t in right["word"]])
        ppl = list(right["ppl"])
        return pd.DataFrame({"word_id": left["word_id"], "ppl": [ppl[p] if p >= 0 else None for p in places]}).astype({"ppl": "float64"})

    return words.groupBy("page_id").cogroup(scored.withColumnRenamed("page_id", "page").groupBy("page")).applyInPandas(one, "word_id long, ppl double")


def judge_predictions(predicted: list[tuple[str, str]], regions: list[tuple[str, list[str]]], threshold: float = 60.0) -> tuple[int, int, int]:
    """(true, false, actual): predicted error words with context against the words of true regions.

    A prediction is false only if a similar paragraph word (the five best) has a similar neighbour on the
    same side; every other one is true.
    """
    like = lambda a, b: round(100 * ratio(a, b))
    places = defaultdict(list)
    for kind, words in regions:
        if kind == "paragraph":
            for i, w in enumerate(words):
                places[w].append((words, i))
    actual = sum(len(w) for kind, w in regions if kind in ERROR_REGIONS)
    known = list(places)
    shapes = np.array([_shape(w) for w in known]).reshape(len(known), BINS)
    true = false = 0
    for word, context in predicted:
        if not word:
            continue
        around = context.split()
        best = max(range(len(around)), key=lambda i: (like(word, around[i]), -i), default=None)
        before = around[best - 1] if best else None
        after = around[best + 1] if best is not None and best + 1 < len(around) else None
        # What the common characters allow is at least the ratio, so words below the threshold are not compared.
        own = _shape(word)
        bound = 2.0 * np.minimum(shapes, own).sum(axis=1) / np.maximum(1, shapes.sum(axis=1) + own.sum())
        close = [known[k] for k in np.flatnonzero(100 * bound >= threshold - 0.5)]
        near = sorted(((like(word, w), w) for w in close), key=lambda x: (-x[0], x[1]))[:5]
        wrong = any(
            (before and i and like(before, words[i - 1]) > threshold) or (after and i + 1 < len(words) and like(after, words[i + 1]) > threshold)
            for score, w in near if score >= threshold for words, i in places[w]
        )
        true, false = true + (not wrong), false + wrong
    return true, false, actual


def predicted_errors(predictions: DataFrame, regions: DataFrame) -> DataFrame:
    """``page_id, tp, fp, actual``; ``predictions``: page_id, word, context; ``regions``: page_id, ord, kind, words."""

    def one(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values("ord")
        tp, fp, actual = judge_predictions([(w or "", c or "") for w, c in zip(left["word"], left["context"], strict=True)], [(k, list(w)) for k, w in zip(right["kind"], right["words"], strict=True)])
        return pd.DataFrame({"page_id": [key[0]], "tp": [tp], "fp": [fp], "actual": [actual]})

    return predictions.groupBy("page_id").cogroup(regions.withColumnRenamed("page_id", "page").groupBy("page")).applyInPandas(one, "page_id string, tp long, fp long, actual long")
