"""Text analysis as native column expressions.

The chain: punctuation to blanks, white space folded, lower case, split at
blanks, stop words removed, then optionally stemmed (functions/porter.py).  An
empty or null text has no tokens.  Only ASCII punctuation and ASCII white space
are treated, so that the result doesn't depend on the engine's Unicode tables.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from spindrift.functions.porter import stem

#: English function words.  A parameter everywhere; ``load_stopwords`` reads another list from a file.
STOPWORDS = tuple(
    """a about above after again against all am an and any are as at be because been before being below between both but by can could did do does
doing down during each few for from further had has have having he her here hers him his how i if in into is it its just me more most my no nor
not of off on once only or other our ours out over own same she should so some such than that the their theirs them then there these they this
those through to too under until up very was we were what when where which while who whom why will with would you your yours""".split()
)

#: Words that part phrases: fixed values, the English stop list that the usual keyword extractor takes (words without apostrophes).
PHRASE_STOPWORDS = tuple(
    """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs
themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or
because as until while of at by for with about against between into through during before after above below to from up down in out on off over under
again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t
can will just don should now d ll m o re ve y ain aren couldn didn doesn hadn hasn haven isn ma mightn mustn needn shan shouldn wasn weren won wouldn""".split()
)

_PUNCT = r"[!-/:-@\[-`{-~]"
_BLANK = r"[\x09-\x0d ]+"
_CONTRACTIONS = (("cannot", "can not"), ("gonna", "gon na"), ("gotta", "got ta"), ("gimme", "gim me"), ("lemme", "lem me"), ("wanna", "wan na"))


def load_stopwords(path: str) -> tuple[str, ...]:
    """The distinct lines of a word list, trimmed; blank lines are skipped."""
    with open(path, encoding="utf-8") as f:
        return tuple(dict.fromkeys(w for w in (line.strip() for line in f) if w))


def squeeze(c: Column) -> Column:
    """Punctuation to blanks, white space folded and trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, _PUNCT, " "), _BLANK, " "))


def clean(c: Column) -> Column:
    """Lower-cased; the dotted capital I becomes a plain i, as its lower case is two characters in some Unicode tables."""
    return F.lower(F.translate(squeeze(c), "\u0130", "I"))


def tokens(c: Column, contractions: bool = False) -> Column:
    """Array of lower-cased tokens, stop words included; empty for empty and null texts."""
    t = clean(c)
    if contractions:
        for word, parts in _CONTRACTIONS:
            t = F.regexp_replace(t, rf"\b{word}\b", parts)
    return F.coalesce(F.filter(F.split(t, " "), lambda x: x != ""), F.array().cast("array<string>"))


def without_stopwords(t: Column, stopwords=STOPWORDS) -> Column:
    return F.filter(t, lambda x: ~x.isin(list(stopwords)))


def phrases(t: Column, stopwords=STOPWORDS) -> Column:
    """Runs of two or three neighbouring tokens between stop words, joined by a blank; runs of other lengths give none."""
    marked = F.array_join(F.transform(t, lambda x: F.when(x.isin(list(stopwords)), "|").otherwise(x)), " ")
    runs = F.transform(F.split(marked, r"\|"), lambda r: F.trim(r))
    return F.filter(runs, lambda r: r.rlike("^[^ ]+( [^ ]+){1,2}$"))


def quoted(c: Column) -> Column:
    """Trimmed non-empty texts in double quotes, in order."""
    found = F.regexp_extract_all(c, F.lit('"(.*?)"'), F.lit(1))
    return F.filter(F.transform(found, lambda p: F.trim(p)), lambda p: p != "")


def occurrences(haystack: Column, needle: Column) -> Column:
    """Number of non-overlapping occurrences."""
    return F.when(F.length(needle) > 0, ((F.length(haystack) - F.length(F.replace(haystack, needle, F.lit("")))) / F.length(needle)).cast("long")).otherwise(F.lit(0).cast("long"))


def positions(haystack: Column, needle: Column) -> Column:
    """Zero-based start positions of non-overlapping occurrences, left to right."""
    parts = F.split(haystack, F.concat(F.lit("\\Q"), needle, F.lit("\\E")), -1)
    acc = F.aggregate(
        parts,
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<long>").alias("found")),
        lambda a, p: F.struct((a["at"] + F.length(p) + F.length(needle)).alias("at"), F.concat(a["found"], F.array(a["at"] + F.length(p))).alias("found")),
    )["found"]
    return F.when(F.length(needle) > 0, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(F.array().cast("array<long>"))


def substring_probability(part: Column, whole: Column) -> Column:
    """Occurrences of ``part`` in ``whole`` over the places where it could start; 0 where it is longer."""
    places = F.length(whole) - F.length(part) + 1
    return F.when(places > 0, occurrences(whole, part) / places).otherwise(F.lit(0.0))


def with_suggestion(text: Column, word: Column, kind: str) -> Column:
    """A query with a suggestion applied: ``fuzzy`` replaces its last token, ``similar`` all of it, other kinds are appended."""
    if kind == "similar":
        return word
    kept = F.regexp_replace(text, r"\S+\s*$", "") if kind == "fuzzy" else F.concat(F.rtrim(text), F.lit(" "))
    return F.concat(F.when(F.trim(text) == "", F.lit("")).otherwise(kept), word)


def analyse_query(text: str, stopwords=STOPWORDS, phrase_stopwords=None, stemmed: bool = False) -> tuple[dict[str, int], list[str], set[str]]:
    """(term -> frequency, phrases, words that must be on the page) of one query string, on the driver.

    Same chain as :func:`tokens`; a quoted single word is a must, a quoted run of two or three words is a phrase;
    longer quoted runs are ignored.  ``stemmed`` stems words, phrases and musts, for an index that is.
    ``phrase_stopwords`` (default: ``stopwords``) part phrases.
    """
    root = stem if stemmed else str
    stop, parting = set(stopwords), set(phrase_stopwords or stopwords)
    t = re.sub(_PUNCT, " ", text or "")
    toks = [w for w in re.sub(_BLANK, " ", t).strip(" ").replace("\u0130", "I").lower().split(" ") if w]
    found: dict[str, int] = {}
    for w in toks:
        if w not in stop:
            found[root(w)] = found.get(root(w), 0) + 1
    runs, run = [], []
    for w in [*toks, None]:
        if w is None or w in parting:
            if 2 <= len(run) <= 3:
                runs.append(" ".join(run))
            run = []
        elif w not in stop:
            run.append(root(w))
    must = set()
    for q in re.findall(r'"(.*?)"', text or ""):
        words = [root(w) for w in re.sub(_BLANK, " ", re.sub(_PUNCT, " ", q)).strip(" ").replace("\u0130", "I").lower().split(" ") if w and w not in stop]
        if len(words) == 1:
            must.add(words[0])
        elif 2 <= len(words) <= 3:
            must.add(" ".join(words))
            if " ".join(words) not in runs:
                runs.append(" ".join(words))
    return found, runs, must
