"""String functions as column builders; every one maps null to null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str.split sees it; Java's \s alone misses the non-breaking and typographic blanks.
WS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
# Word classes and endings of the text rules.
ARTICLES = ("a", "an", "the")
#: The stop words where none are given; a library's list may be passed instead.
STOP_WORDS = (
    "a about after all also an and any are as at be been but by can could did do does for from had has have he her him his how i if in into is it "
    "its just me more most my no not of on one only or other our out over own same she so some such than that the their them then there these they "
    "this those to too up very was we were what when where which while who whom why will with would you your"
).split()
BRACKETS = {"-LRB-": "(", "-RRB-": ")", "-LSB-": "[", "-RSB-": "]", "-LCB-": "{", "-RCB-": "}", "-COLON-": ":"}
REWRITES = (
    ("’", "'"), ("‘", "'"), (" .", "."), (" ?", "?"), (" !", "!"), (" ,", ","), (" ;", ";"), (" :", ":"), ("`` ", "'"), (" ''", "'"), (" 's", "'s"),
    ("“", '"'), ("”", '"'), ("\t", " "), ("\n", ""),
)
SENTENCE_END = (".", "?", "!", ":", ";")


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, build) -> Column:
    """``build`` of a value that is computed once, also where a lambda uses it for every element."""
    return F.element_at(F.transform(F.array(value), build), 1)


def replace_all(x: Column | str, pairs) -> Column:
    """Literal replacements, one after the other."""
    out = col(x)
    for old, new in pairs:
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def strip(x: Column | str) -> Column:
    return F.regexp_replace(col(x), f"^{WS}+|{WS}+$", "")


def squeeze(x: Column | str) -> Column:
    """White space runs to one blank, none at the ends."""
    return F.trim(F.regexp_replace(col(x), f"{WS}+", " "))


def words(x: Column | str) -> Column:
    """Words between white space; none for blank text."""
    return F.filter(F.split(squeeze(x), " "), lambda w: w != "")


def clean(x: Column | str) -> Column:
    """Without control characters, format characters and U+FFFD; white space to blanks, tab and line ends among it."""
    blanks = F.regexp_replace(col(x), r"[\t\n\r]|\p{Zs}", " ")
    return F.regexp_replace(blanks, r"[\p{Cc}\p{Cf}\x{fffd}]", "")


def norm_text(x: Column | str) -> Column:
    return squeeze(clean(x))


def replace_control(x: Column | str, by: str = " ") -> Column:
    return F.regexp_replace(col(x), r"[^\P{C}\t\n\r]", by)


def convert_brackets(x: Column | str) -> Column:
    return replace_all(x, BRACKETS.items())


def replace_chars(x: Column | str) -> Column:
    return replace_all(x, REWRITES)


def ends_with_any(x: Column, ends) -> Column:
    return F.substring(x, -1, 1).isin(*ends)


def close_sentence(x: Column, ends=(".", "?", "!"), by: str = ".") -> Column:
    """With a final mark; empty text stays empty."""
    return F.when((x == "") | ends_with_any(x, ends), x).otherwise(F.concat(x, F.lit(by)))


def capitalise_first(x: Column) -> Column:
    return F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 1 << 30))


def format_sentence(x: Column | str) -> Column:
    return capitalise_first(close_sentence(replace_chars(squeeze(x)), SENTENCE_END))


def remove_tags(x: Column | str) -> Column:
    return F.regexp_replace(col(x), "<[^>]*>", "")


def paragraphs(x: Column | str) -> Column:
    """Lines without tags and outer blanks, empty ones dropped."""
    return F.filter(F.transform(F.split(remove_tags(x), "\n"), strip), lambda p: p != "")


def sentences(x: Column | str) -> Column:
    """Sentences by final marks followed by white space; a rule, where the reference asks a model."""
    return F.filter(F.transform(F.split(strip(x), rf"(?<=[.!?]){WS}+"), strip), lambda s: s != "")


def drop_stop_words(x: Column | str, stops=STOP_WORDS) -> Column:
    """Words between single blanks that are not stop words, joined again."""
    return F.array_join(F.filter(F.split(col(x), " "), lambda w: ~F.lower(w).isin(*stops)), " ")


def kept_words(tokens: Column, stops=STOP_WORDS) -> Column:
    """(word, position) of the words that are not stop words."""
    with_position = F.transform(tokens, lambda w, i: F.struct(w.alias("word"), i.cast("int").alias("pos")))
    return F.filter(with_position, lambda t: ~F.lower(t["word"]).isin(*stops))


def simple_tokens(x: Column | str) -> Column:
    """Runs of letters, digits and marks, or single other visible characters."""
    return F.regexp_extract_all(col(x), F.lit(r"[\p{L}\p{N}\p{M}]+|[^\p{Z}\p{C}]"), F.lit(0))


def ngrams(tokens: Column, most: int) -> Column:
    """All n-grams of 1 to ``most`` tokens by start, then length, joined by blanks."""

    def build(t: Column) -> Column:
        of = lambda w, i: F.transform(
            F.sequence(F.lit(1), F.least(F.lit(most), F.size(t) - i)), lambda n: F.array_join(F.slice(t, i + 1, n), " ")
        )
        return F.flatten(F.transform(t, of))

    return let(tokens, build)


def is_filler(word: Column, stops=STOP_WORDS) -> Column:
    """A stop word, or nothing but punctuation."""
    return F.lower(word).isin(*stops) | word.rlike(r"^\p{P}*$")


def keep_ngram(words_: Column, mode: str, stops=STOP_WORDS) -> Column:
    """Whether an n-gram is to be filtered: any, all or one of the ends is a filler."""
    filler = lambda w: is_filler(w, stops)
    if mode == "any":
        return F.exists(words_, filler)
    if mode == "all":
        return F.forall(words_, filler)
    if mode == "ends":
        return filler(F.element_at(words_, 1)) | filler(F.element_at(words_, -1))
    raise ValueError(mode)


def contains_tokens(tokens: Column, part: Column) -> Column:
    """Whether ``part`` is a contiguous run of ``tokens``; an empty part is not."""
    fence = lambda t: F.concat(F.lit("\x01"), F.array_join(t, "\x01"), F.lit("\x01"))
    return let(part, lambda p: (F.size(p) > 0) & F.contains(fence(tokens), fence(p)))


def base_ten(number: Column | str) -> Column:
    """'123' as '1 10e2 2 10e1 3 10e0', with sign and decimals."""
    n = col(number)
    bare = F.regexp_replace(n, "^-", "")
    digits = F.replace(bare, F.lit("."), F.lit(""))
    point = F.instr(bare, ".")
    highest = F.when(point > 0, point - 2).otherwise(F.length(digits) - 1)
    parts = let(highest, lambda h: F.transform(F.split(digits, ""), lambda d, i: F.concat(d, F.lit(" 10e"), (h - i).cast("string"))))
    return F.concat(F.when(n.startswith("-"), F.lit("- ")).otherwise(F.lit("")), F.array_join(parts, " "))


def split_digits(pieces: Column, special: str = "Ġ") -> Column:
    """Numeric word pieces cut into their digits; the piece marker stays on the first."""
    numeric = lambda p: p.rlike(f"^[{special}0-9.,^$-]+$") & (p != special)
    cut = lambda p: F.transform(
        F.split(F.replace(p, F.lit(special), F.lit("")), ""),
        lambda d, i: F.when((i == 0) & p.startswith(special), F.concat(F.lit(special), d)).otherwise(d),
    )
    return F.flatten(F.transform(pieces, lambda p: F.when(numeric(p), cut(p)).otherwise(F.array(p))))


def fix_number_spacing(x: Column | str) -> Column:
    """A blank between a letter or mark and a digit or minus."""
    return F.regexp_replace(col(x), r"([a-z,:;>])([0-9-])", "$1 $2")


def unescape(x: Column | str) -> Column:
    """The five HTML entities that titles use, and the two numeric quotes, in one pass each, the ampersand last."""
    entities = (("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"))
    return replace_all(x, entities)


def cloze_awb(text: Column, answer: Column, mask: str) -> Column:
    """'[A], who [B]': the masked answer between the two fragments."""
    padded = F.concat(F.lit(" "), text, F.lit(" "))
    quoted = F.concat(F.lit(r"(?U)\W+\Q"), answer, F.lit(r"\E\W+"))
    out = F.regexp_replace(padded, quoted, F.lit(f", {mask} "))
    return F.regexp_replace(strip(F.regexp_replace(out, r"(?U)^,\s*", "")), ",$", "")


def cloze_wba(text: Column, answer: Column, mask: str) -> Column:
    """'Who [B], [A]'."""
    padded = F.concat(F.lit(" "), text, F.lit(" "))
    quoted = F.concat(F.lit(r"(?U)^(.*?)\W+\Q"), answer, F.lit(r"\E\W+(.*?)\W*$"))
    out = strip(F.regexp_replace(padded, quoted, F.lit(f"{mask} $2, $1")))
    return F.regexp_replace(F.regexp_replace(out, r"(?U)^,\s*", ""), r"(?U)\s+", " ")
