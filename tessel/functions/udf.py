"""Functions that Spark SQL cannot express, as Arrow-batched UDFs; every one maps null to null."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from functools import cache, lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def nfd(x: Column | str) -> Column:
    """Canonical decomposition."""

    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: unicodedata.normalize("NFD", t), na_action="ignore")

    return F.pandas_udf(run, "string")(x)


def strip_accents(x: Column | str) -> Column:
    """Without combining marks."""
    drop = lambda t: t if t.isascii() else "".join(c for c in unicodedata.normalize("NFD", t) if unicodedata.category(c) != "Mn")

    def run(s: pd.Series) -> pd.Series:
        return s.map(drop, na_action="ignore")

    return F.pandas_udf(run, "string")(x)


def fold(x: Column | str) -> Column:
    """Without accents, composed."""
    plain = lambda t: t if t.isascii() else unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", t) if unicodedata.category(c) != "Mn"))

    def run(s: pd.Series) -> pd.Series:
        return s.map(plain, na_action="ignore")

    return F.pandas_udf(run, "string")(x)


def longest_common_run(a, b) -> tuple[int, int]:
    """(length, start in a) of the longest common substring of two sequences, the first in ``a`` of equal ones: a row of the table at a time."""
    if not len(a) or not len(b):
        return 0, 0
    if isinstance(a, str):
        x, y = (np.frombuffer(t.encode("utf-32-le"), "u4") for t in (a, b))
    else:
        codes: dict = {}
        x, y = (np.array([codes.setdefault(t, len(codes)) for t in s], "i8") for s in (a, b))
    best, at = 0, 0
    row = np.zeros(len(y) + 1, "i8")
    for i, c in enumerate(x, 1):
        row[1:] = np.where(y == c, row[:-1] + 1, 0)
        if (top := int(row.max())) > best:
            best, at = top, i - top
    return best, at


def longest_common_subsequence(a, b) -> int:
    """Length of the longest common subsequence: a column of the table as the bits of one integer (Hyyrö)."""
    masks: dict = {}
    for j, y in enumerate(b):
        masks[y] = masks.get(y, 0) | 1 << j
    full = (1 << len(b)) - 1
    row = full
    for x in a:
        hit = row & masks.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(b) - row.bit_count()


def common_substring(a: Column | str, b: Column | str) -> Column:
    """struct(length, value, start) of the longest common substring of two texts by characters."""

    def run(left: pd.Series, right: pd.Series) -> pd.DataFrame:
        rows = []
        for x, y in zip(left, right, strict=True):
            n, at = (None, None) if x is None or y is None else longest_common_run(x, y)
            rows.append((n, None if n is None else x[at : at + n], at))
        return pd.DataFrame(rows, columns=["length", "value", "start"]).astype({"length": "Int32", "start": "Int32"})

    return F.pandas_udf(run, "length int, value string, start int")(a, b)


def common_subsequence(a: Column | str, b: Column | str) -> Column:
    """Length of the longest common subsequence of two token lists."""

    def run(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else longest_common_subsequence(list(x), list(y)) for x, y in zip(left, right, strict=True)], dtype="Int32")

    return F.pandas_udf(run, "int")(a, b)


# English number words.
UNITS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
SCALES = {"thousand": 10**3, "million": 10**6, "billion": 10**9, "trillion": 10**12}


@cache
def number_words() -> dict[str, int]:
    return {w: i for i, w in enumerate(UNITS)} | {w: 10 * i for i, w in enumerate(TENS, 2)}


def words_to_number(text: str) -> float | None:
    """The value of an English number phrase or of digits with commas; null if it is none. A bare scale is none."""
    bare = text.strip().lower().replace(",", "").strip(".!?$%\"'")
    try:
        return float(bare) if bare not in ("nan", "inf", "infinity") else None
    except ValueError:
        pass
    words = [w for w in bare.replace("-", " ").split() if w != "and"]
    whole, _, decimals = " ".join(words).partition(" point ")
    total = current = 0
    seen = False
    for w in whole.split():
        if w in number_words():
            current, seen = current + number_words()[w], True
        elif w == "hundred" and current:
            current *= 100
        elif w in SCALES and current:
            total, current = total + current * SCALES[w], 0
        else:
            return None
    digits = [number_words().get(w, 10) for w in decimals.split()]
    if not seen or any(d > 9 for d in digits):
        return None
    return total + current + sum(d / 10**i for i, d in enumerate(digits, 1))


def to_number(x: Column | str) -> Column:
    def run(s: pd.Series) -> pd.Series:
        return s.map(words_to_number, na_action="ignore").astype("float64")

    return F.pandas_udf(run, "double")(x)


# The suffix rules of the published Porter algorithm, longest first where one ends another.
STEP2 = (
    "ational ate, tional tion, enci ence, anci ance, izer ize, abli able, alli al, entli ent, eli e, ousli ous, ization ize, ation ate, ator ate, alism al, iveness ive, "
    "fulness ful, ousness ous, aliti al, iviti ive, biliti ble"
)
STEP3 = "icate ic, ative , alize al, iciti ic, ical ic, ful , ness "
STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize"


def _pairs(rules: str) -> list[tuple[str, str]]:
    return sorted(((x.split(" ")[0], x.split(" ")[1]) for x in rules.split(", ")), key=lambda x: -len(x[0]))


_STEPS = (_pairs(STEP2), _pairs(STEP3), sorted(STEP4.split(), key=lambda x: -len(x)))


def _shape(word: str) -> str:
    """c or v for every letter; y is a vowel after a consonant."""
    out = ""
    for c in word:
        out += "v" if c in "aeiou" or (c == "y" and out[-1:] == "c") else "c"
    return out


def _measure(word: str) -> int:
    """How often a consonant follows a vowel."""
    return _shape(word).count("vc")


def _short(word: str) -> bool:
    """Whether it ends consonant, vowel, consonant, the last none of w, x, y."""
    return _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


@lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    """The stem of an English word by the Porter algorithm; words of one or two letters stay."""
    w = word.lower()
    if len(w) <= 2:
        return w
    for end, by in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(end):
            w = w[: len(w) - len(end)] + by
            break
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            rest = w[: -len(end)]
            if w.endswith(end):
                if "v" in _shape(rest):
                    w = rest
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c" and w[-1] not in "lsz":
                        w = w[:-1]
                    elif _measure(w) == 1 and _short(w):
                        w += "e"
                break
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for rules in _STEPS[:2]:
        for end, by in rules:
            if w.endswith(end):
                w = w[: -len(end)] + by if _measure(w[: -len(end)]) > 0 else w
                break
    for end in _STEPS[2]:
        if w.endswith(end):
            rest = w[: -len(end)]
            if _measure(rest) > 1 and (end != "ion" or rest.endswith(("s", "t"))):
                w = rest
            break
    if w.endswith("e") and (_measure(w[:-1]) > 1 or (_measure(w[:-1]) == 1 and not _short(w[:-1]))):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and _measure(w) > 1 else w


# The rules, exceptions and prefixes of the published English (Porter2) stemmer.
DOUBLES = "bb dd ff gg mm nn pp rr tt".split()
LI_BEFORE = "cdeghkmnrt"
REGIONS = "gener commun arsen".split()
WHOLE = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
AFTER_S = "inning outing canning herring earring proceed exceed succeed".split()
SECOND = (
    "tional tion, enci ence, anci ance, abli able, entli ent, izer ize, ization ize, ational ate, ation ate, ator ate, alism al, aliti al, alli al, fulness ful, ousli ous, ousness ous, "
    "iveness ive, iviti ive, biliti ble, bli ble, ogi og, fulli ful, lessli less, li "
)
THIRD = "tional tion, ational ate, alize al, icate ic, iciti ic, ical ic, ful , ness , ative "
FOURTH = sorted("al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split(), key=lambda x: -len(x))
_SECOND, _THIRD = _pairs(SECOND), _pairs(THIRD)
VOWELS = "aeiouy"


def _region(word: str, start: int) -> int:
    """Where the rest after the first non-vowel after a vowel begins."""
    for i in range(start + 1, len(word)):
        if word[i] not in VOWELS and word[i - 1] in VOWELS:
            return i + 1
    return len(word)


def _ends_short(word: str) -> bool:
    """Whether it ends with a short syllable."""
    if len(word) == 2:
        return word[0] in VOWELS and word[1] not in VOWELS
    return len(word) > 2 and word[-3] not in VOWELS and word[-2] in VOWELS and word[-1] not in VOWELS + "wxY"


@lru_cache(maxsize=100_000)
def stem_english(word: str) -> str:
    """The stem of an English word by the Snowball (Porter2) algorithm; words of one or two letters stay."""
    w = word.lower().replace("’", "'").replace("‘", "'")
    if len(w) <= 2:
        return w
    w = w[1:] if w.startswith("'") else w
    if w in WHOLE:
        return WHOLE[w]
    w = re.sub("^y|(?<=[aeiouy])y", "Y", w)
    one = next((len(p) for p in REGIONS if w.startswith(p)), None)
    one = _region(w, 0) if one is None else one
    two = _region(w, one)
    for end in ("'s'", "'s", "'"):
        if w.endswith(end):
            w = w[: -len(end)]
            break
    vowel = lambda t: any(c in VOWELS for c in t)
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and vowel(w[:-2]):
        w = w[:-1]
    if w in AFTER_S:
        return w
    for end in ("eedly", "ingly", "edly", "eed", "ing", "ed"):
        if w.endswith(end):
            rest = w[: -len(end)]
            if end.startswith("eed"):
                w = rest + "ee" if len(rest) >= one else w
            elif vowel(rest):
                w = rest
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif w[-2:] in DOUBLES:
                    w = w[:-1]
                elif one >= len(w) and _ends_short(w):
                    w += "e"
            break
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in VOWELS:
        w = w[:-1] + "i"
    for end, by in _SECOND:
        if w.endswith(end):
            rest = w[: -len(end)]
            allowed = rest.endswith("l") if end == "ogi" else rest[-1:] in LI_BEFORE and rest != "" if end == "li" else True
            w = rest + by if len(rest) >= one and allowed else w
            break
    for end, by in _THIRD:
        if w.endswith(end):
            rest = w[: -len(end)]
            w = rest + by if len(rest) >= (two if end == "ative" else one) else w
            break
    for end in FOURTH:
        if w.endswith(end):
            rest = w[: -len(end)]
            w = rest if len(rest) >= two and (end != "ion" or rest.endswith(("s", "t"))) else w
            break
    if w.endswith("e"):
        rest = w[:-1]
        w = rest if len(rest) >= two or (len(rest) >= one and not _ends_short(rest)) else w
    elif w.endswith("ll") and len(w) - 1 >= two:
        w = w[:-1]
    return w.replace("Y", "y")


def stems(tokens: Column | str, kind: str = "porter") -> Column:
    """Stems of a list of tokens, by ``porter`` or ``snowball``."""
    one = {"porter": stem, "snowball": stem_english}[kind]

    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else [one(w) for w in t])

    return F.pandas_udf(run, "array<string>")(tokens)


# The token classes of the Penn-like tokenizer, in order.
_ALNUM = r"[\p{L}\p{N}\p{M}]++"
CLASSES = {
    "digit": r"\p{Nd}+([:\.\,]\p{Nd}+)*",
    "title": r"(dr|esq|hon|jr|mr|mrs|ms|prof|rev|sr|st|rt|messrs|mmes|msgr)\.(?=\p{Z})",
    "abbreviation": r"([\p{L}]\.){2,}(?=\p{Z}|$)",
    "negation": r"((?!n't)[\p{L}\p{N}\p{M}])++(?=n't)|n't",
    "hyphenated": _ALNUM + r"([-\u058A\u2010\u2011]" + _ALNUM + ")+",
    "cannot": r"can(?=not\b)",
    "word": _ALNUM,
    "contraction": r"'([tsdm]|re|ll|ve)\b",
    "open_double": r"(?<=[\p{Z}\(\[{<]|^)(``|[\"\u0093\u201C\u00AB])(?!\p{Z})",
    "close_double": r"(?<!\p{Z})(''|[\"\u0094\u201D\u00BB])",
    "open_single": r"(?<=[\p{Z}\(\[{<]|^)['\u0091\u2018\u201B\u2039](?!\p{Z})",
    "close_single": r"(?<!\p{Z})['\u0092\u2019\u203A]",
    "dash": r"--|[\u0096\u0097\u2013\u2014\u2015]",
    "ellipsis": r"\.\.\.|\u2026",
    "punctuation": r"\p{P}",
    "other": r"[^\p{Z}\p{C}]",
}
NORMAL = {"open_double": "``", "close_double": "''", "open_single": "`", "close_single": "'", "dash": "--", "ellipsis": "..."}


@cache
def _penn():
    import regex

    return regex.compile("|".join(f"(?P<{name}>{pattern})" for name, pattern in CLASSES.items()), regex.IGNORECASE | regex.UNICODE | regex.MULTILINE)


def penn_tokens(text: str) -> list[tuple[str, int, int]]:
    """(token, start, end) of sixteen classes, the first that matches at a place; quotes, dashes and ellipses in one form."""
    return [(NORMAL.get(m.lastgroup, m.group()), *m.span()) for m in _penn().finditer(text)]


def penn(x: Column | str) -> Column:
    """array<struct<token, s, e>> of :func:`penn_tokens`."""

    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: [{"token": w, "s": a, "e": b} for w, a, b in penn_tokens(t)], na_action="ignore")

    return F.pandas_udf(run, "array<struct<token: string, s: int, e: int>>")(x)


def normalise_numbers(text: str, base_ten: bool = False) -> str:
    """The text with its numbers, in digits or in a word, as plain numbers or in place notation; other words and the blanks between stay."""

    def one(m) -> str:
        token = m[0]
        if not (token.lower().strip(".,") in number_words() or (len(token) > 1 and set(token) <= set("0123456789,-."))):
            return token
        value = words_to_number(token)
        if value is None:
            return token
        whole = value == int(value) and "." not in token.strip(".,")
        number = str(int(value)) if whole else str(value)
        return places(number) if base_ten else number

    return re.sub(r"\S+", one, text)


def places(number: str) -> str:
    """'123' as '1 10e2 2 10e1 3 10e0'."""
    whole, _, rest = number.lstrip("-").partition(".")
    digits = [f"{d} 10e{len(whole) - 1 - i}" for i, d in enumerate(whole + rest)]
    return ("- " if number.startswith("-") else "") + " ".join(digits)


def with_normal_numbers(x: Column | str, base_ten: bool = False) -> Column:
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: normalise_numbers(t, base_ten), na_action="ignore")

    return F.pandas_udf(run, "string")(x)


def _grams(tokens: list[str], most: int) -> Counter:
    return Counter(tuple(tokens[i : i + n]) for n in range(1, most + 1) for i in range(len(tokens) - n + 1))


def bleu(tokens: list[str], references: list[list[str]], most: int = 2, smooth: bool = False) -> float:
    """100 x BLEU of one token list against several: clipped n-gram precision, brevity by the shortest reference; smoothing adds one to both counts."""
    clip: Counter = Counter()
    for r in references:
        clip |= _grams(r, most)
    hit, total = [0] * most, [max(0, len(tokens) - n) for n in range(most)]
    for gram, n in (_grams(tokens, most) & clip).items():
        hit[len(gram) - 1] += n
    share = [(h + 1) / (t + 1) if smooth else h / t if t else 0.0 for h, t in zip(hit, total, strict=True)]
    if min(share) <= 0 or not references or not tokens:
        return 0.0
    ratio = len(tokens) / max(1, min(len(r) for r in references))
    return 100 * math.exp(sum(math.log(p) for p in share) / most) * (math.exp(1 - 1 / ratio) if ratio <= 1 else 1.0)


def self_bleu(texts: list[list[str]], most: int = 2, smooth: bool = False) -> list[float]:
    """BLEU of every token list against all others."""
    return [bleu(t, texts[:i] + texts[i + 1 :], most, smooth) for i, t in enumerate(texts)]


def soft_unique(texts: list[list[str]], below: float = 50, most: int = 2, smooth: bool = True) -> list[int]:
    """Places of the token lists that stay when the one most like the others goes until their mean self-BLEU is at most ``below`` or two are left."""
    kept = list(range(len(texts)))
    while len(kept) > 2:
        scores = self_bleu([texts[i] for i in kept], most, smooth)
        if sum(scores) / len(scores) <= below:
            break
        kept.pop(scores.index(max(scores)))
    return kept


def self_bleus(lists: Column | str) -> Column:
    """array<double> of :func:`self_bleu` of lists of texts cut at blanks."""

    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else self_bleu([(t or "").split() for t in x]))

    return F.pandas_udf(run, "array<double>")(lists)


def soft_uniques(lists: Column | str) -> Column:
    """array<int> of :func:`soft_unique` of lists of texts cut at blanks."""

    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else soft_unique([(t or "").split() for t in x]))

    return F.pandas_udf(run, "array<int>")(lists)


def best_assignment(scores: np.ndarray) -> list[tuple[int, int]]:
    """(row, column) pairs of the assignment of the highest sum, each row and column at most once (shortest augmenting paths)."""
    flip = scores.shape[0] > scores.shape[1]
    cost = -(scores.T if flip else scores)
    n, m = cost.shape
    u, v, owner = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        owner[0], at = i, 0
        least, back, seen = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while owner[at]:
            seen[at] = True
            slack = cost[owner[at] - 1] - u[owner[at]] - v[1:]
            better = ~seen[1:] & (slack < least[1:])
            least[1:][better], back[1:][better] = slack[better], at
            to = int(np.where(seen, np.inf, least)[1:].argmin()) + 1
            step = least[to]
            u[owner[seen]] += step
            v[seen] -= step
            least[~seen] -= step
            at = to
        while at:
            owner[at], at = owner[back[at]], back[at]
    pairs = [(owner[j] - 1, j - 1) for j in range(1, m + 1) if owner[j]]
    return sorted((j, i) if flip else (i, j) for i, j in pairs)


def aligned_f1(predicted: list[set[str]], gold: list[set[str]]) -> float:
    """Mean F1 over spans given as token sets in their best one-to-one alignment, over as many places as the longer side has, to two places; a gold span with numbers
    matches only a predicted one with one of them."""
    scores = np.zeros((len(gold), len(predicted)))
    for i, g in enumerate(gold):
        numbers = {w for w in g if _is_float(w)}
        for j, p in enumerate(predicted):
            if not numbers or numbers & p:
                both = len(g & p)
                precision, recall = both / len(p) if p else 1.0, both / len(g) if g else 1.0
                scores[i, j] = 2 * precision * recall / (precision + recall) if precision + recall else 0.0
    best = [scores[i, j] for i, j in best_assignment(scores)] if gold and predicted else []
    return round(sum(best) / max(len(gold), len(predicted), 1), 2)


def _is_float(word: str) -> bool:
    try:
        float(word)
    except ValueError:
        return False
    return True


def span_f1(predicted: Column, gold: Column) -> Column:
    """:func:`aligned_f1` of two lists of token lists."""

    def run(p: pd.Series, g: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else aligned_f1([set(t) for t in x], [set(t) for t in y]) for x, y in zip(p, g, strict=True)], dtype="float64")

    return F.pandas_udf(run, "double")(predicted, gold)


def original_span(pred: Column | str, text: Column | str) -> Column:
    """The part of the original text whose letters and digits are those of a normalised prediction; the prediction where there is none."""

    def find(p: str, t: str) -> str:
        plain = [(i, c) for i, ch in enumerate(t) for c in unicodedata.normalize("NFD", ch).lower() if c.isalnum()]
        want = "".join(c for ch in p for c in unicodedata.normalize("NFD", ch).lower() if c.isalnum())
        at = "".join(c for _, c in plain).find(want) if want else -1
        return p if at < 0 else t[plain[at][0] : plain[at + len(want) - 1][0] + 1]

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else find(x, y) for x, y in zip(a, b, strict=True)])

    return F.pandas_udf(run, "string")(pred, text)
