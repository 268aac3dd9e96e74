"""Text analysis: tokens, the web-search query language, and an English analyzer (stop words, and stems by Porter2)."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

_TOKEN = r"[\p{L}\p{N}]+"


def simple_tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits, in order; none for a null."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(f"({_TOKEN})"), F.lit(1)), F.array().cast("array<string>"))


# The stop words of the English analyzer.
STOP_WORDS = frozenset(
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by for with about against between into through during before after above below to from up down in out on off over under again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now".split()
)
# Fixed values of the published English stemmer (Porter2); one more of its irregular words is stemmed by rule here.
IRREGULAR = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
KEPT_AFTER_PLURAL = frozenset("inning outing canning herring earring proceed exceed succeed".split())
STEP_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al",
    "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
STEP_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEP_4 = dict.fromkeys("al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split(), "")
_REGION = re.compile("[aeiouy][^aeiouy]")
_VOWEL = re.compile("[aeiouy]")
_SHORT = re.compile("(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$")
_DOUBLE = re.compile("(?:bb|dd|ff|gg|mm|nn|pp|rr|tt)$")


def _longest(table: Iterable[str]) -> re.Pattern:
    """A word's longest ending of a table."""
    return re.compile("(?:" + "|".join(sorted(table, key=len, reverse=True)) + ")$")


_ENDS_2, _ENDS_3, _ENDS_4 = map(_longest, (STEP_2, STEP_3, STEP_4))


def _regions(word: str) -> tuple[int, int]:
    """Where R1 and R2 begin: behind the first consonant after a vowel, and once more."""
    fixed = re.match("gener|commun|arsen", word)
    first = fixed or _REGION.search(word)
    r1 = first.end() if first else len(word)
    second = _REGION.search(word, r1)
    return r1, second.end() if second else len(word)


def stem(word: str) -> str:
    """The stem of a lower-cased word by the published Porter2 algorithm; letters beyond a-z count as consonants."""
    if word in IRREGULAR or len(word) < 3:
        return IRREGULAR.get(word, word)
    word = re.sub("([aeiouy])y", r"\1Y", "Y" + word[1:] if word[0] == "y" else word)
    r1, r2 = _regions(word)
    # plurals
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and _VOWEL.search(word[:-2]):
        word = word[:-1]
    if word in KEPT_AFTER_PLURAL:
        return word
    # -ed and -ing
    if found := re.search("eed(?:ly)?$", word):
        word = word[: found.start()] + "ee" if found.start() >= r1 else word
    elif (found := re.search("(?:ed|ing)(?:ly)?$", word)) and _VOWEL.search(word[: found.start()]):
        word = word[: found.start()]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif _DOUBLE.search(word):
            word = word[:-1]
        elif r1 >= len(word) and _SHORT.search(word):
            word += "e"
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in "aeiouy":
        word = word[:-1] + "i"
    # derivations
    if (found := _ENDS_2.search(word)) and (at := found.start()) >= r1:
        end, before = found.group(), word[at - 1 : at]
        if (end != "ogi" or before == "l") and (end != "li" or before in tuple("cdeghkmnrt")):
            word = word[:at] + STEP_2[end]
    if (found := _ENDS_3.search(word)) and found.start() >= (r2 if found.group() == "ative" else r1):
        word = word[: found.start()] + STEP_3[found.group()]
    if (found := _ENDS_4.search(word)) and found.start() >= r2 and (found.group() != "ion" or word[: found.start()].endswith(("s", "t"))):
        word = word[: found.start()]
    last = len(word) - 1
    if word.endswith("e"):
        word = word[:-1] if last >= r2 or last >= r1 and not _SHORT.search(word[:-1]) else word
    elif word.endswith("ll") and last >= r2:
        word = word[:-1]
    return word.replace("Y", "y")


class Stems(dict):
    """Word -> its stem, null for a stop word; of the last MOST words met at least."""

    MOST = 200_000

    def __missing__(self, word: str) -> str | None:
        if len(self) >= self.MOST:
            self.clear()
        self[word] = found = None if word in STOP_WORDS else stem(word)
        return found


@dataclass(frozen=True)
class Clause:
    """Consecutive terms (one, or a quoted phrase; null where a stop word stood), wanted or not."""

    terms: tuple[str | None, ...]
    negated: bool = False


def parse_websearch(query: str | None, english: bool = False) -> list[list[Clause]]:
    """Alternatives (``or``) of clauses that must all hold; ``-`` negates, quotes make a phrase.

    A query of stop words only, or of none, has no alternatives and matches nothing.
    """
    groups: list[list[Clause]] = [[]]
    for minus, quoted, bare in re.findall(r'(-?)(?:"([^"]*)"?|([^\s"]+))', query or ""):
        if not quoted and bare.lower() == "or" and not minus:
            groups.append([])
            continue
        words = [w.lower() for w in re.findall(r"[^\W_]+", quoted or bare)]
        terms = [None if w in STOP_WORDS else stem(w) for w in words] if english else words
        while terms and terms[0] is None:
            terms.pop(0)
        while terms and terms[-1] is None:
            terms.pop()
        if terms:
            groups[-1].append(Clause(tuple(terms), bool(minus)))
    return [g for g in groups if g]


def bag_of_words(query: str | None, english: bool = False) -> list[list[Clause]]:
    """All words of a text as alternatives, without a query language."""
    words = [w.lower() for w in re.findall(r"[^\W_]+", query or "")]
    return [[Clause((stem(w) if english else w,))] for w in dict.fromkeys(words) if not (english and w in STOP_WORDS)]


def query_terms(groups: list[list[Clause]]) -> list[str]:
    """Distinct terms of a parsed query; negated ones too."""
    return sorted({t for g in groups for c in g for t in c.terms if t is not None})


def _holds(tokens: Column, clause: Clause) -> Column:
    if len(clause.terms) == 1:
        found = F.array_contains(tokens, clause.terms[0])
    else:
        line = F.concat(F.lit(" "), F.array_join(tokens, " ", "*"), F.lit(" "))
        found = line.rlike(" " + " ".join("[^ ]+" if t is None else t for t in clause.terms) + " ")
    found = F.coalesce(found, F.lit(False))
    return ~found if clause.negated else found


def matches(tokens: Column, groups: list[list[Clause]]) -> Column:
    """Whether a token array satisfies a parsed query."""
    any_group = F.lit(False)
    for g in groups:
        every = F.lit(True)
        for c in g:
            every = every & _holds(tokens, c)
        any_group = any_group | every
    return any_group
