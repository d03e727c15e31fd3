"""One consistent form of text that looks the same: normalisation, then a lattice search over look-alike letters.

First, compatibility forms that look like the plain form are replaced (full and half width, joined letters, blanks of
every kind), characters that are not visible are deleted, runs of blanks become one, line ends one kind, combining marks
composed. Then every token is read as a lattice: each letter may be any member of its class of look-alike letters.
Viterbi finds the path of the highest score under bigram models of the scripts' letters, learnt from the whole
corpus's tokens of a single script, with a price for changing the script within a token.

Letters that are drawn alike are one class and may stand for each other everywhere. Letters that are only near each other (Greek nu and v, Cyrillic ka and k)
may do so, at a price below that of a change of script, in tokens that cannot be read in one script as they stand: there the lattice decides which
letters are meant. A token of one script is never changed by them, so words of two scripts that differ visibly stay different.

Texts look the same when their tokens' best paths go through the same classes. A token that can be read in one script goes through its own classes, whichever
member the path takes, so pairs of texts need the search only for the few texts with other tokens: the others are compared by the digest of their
classes from the one pass over the corpus that also counts the bigrams.

Defined cases: null gives null; text without a visible character gives the empty string and is equal to nothing; superscripts,
circled and other forms that look different stay; a zero-width joiner between two pictographs stays; ties go to the
member that comes first in its class (the Latin one).
"""

from __future__ import annotations

import hashlib
import math
import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import cache, lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.llm import hot
from tessel.session import cut

# Letters of Latin, Cyrillic, Greek, Armenian, Cherokee and Lisu script that are drawn alike, a class each, Latin first.
CLASSES = (
    "aаɑ cсϲ dԁ eе gɡ hһ iі jјϳ oоοօ pр qԛ sѕ vѵ wԝ xх yу lӏ "
    "AАΑᎪꓮ BВΒᏴꓐ CСϹᏟꓚ DᎠꓓ EЕΕᎬꓰ Fꓝ Gꓖ HНΗᎻꓧ IІΙӀꓲ JЈᎫꓙ KКΚᏦꓗ LᏞꓡ MМΜᎷꓟ NΝꓠ OОΟՕꓳ PРΡᏢꓑ QԚ RᏒꓣ SЅՏᏚꓢ TТΤᎢꓔ UՍꓴ VѴᏙꓦ WԜᎳꓪ XХΧꓫ YҮΥꓬ ZΖᏃꓜ"
).split()
# Small letters that are near a Latin one, the Latin one first.
NEAR = "aα bь gց hհ iι kкκ mм nոп oσ pρ qգ rг tтτ uυս vν wωա xχ yγ".split()
#: Invisible characters that are neither format characters nor controls: fixed values.
FILLERS = "͏ᅟᅠ឴឵᠋᠌᠍᠏ㅤﾠ"
KINDS = ("<wide>", "<narrow>", "<noBreak>", "<compat>", "<initial>", "<medial>", "<final>", "<isolated>", "<small>", "<vertical>")
#: Documents of a block of one text.
BLOCK = 100_000
SWITCH, NEARLY, UNSEEN, KEPT = 8.0, 3.0, 14.0, 200_000


def _runs(kinds: str) -> str:
    """A character class of the 16-bit code points whose category begins with one of the letters."""
    inside = [unicodedata.category(chr(p))[0] in kinds for p in range(1 << 16)]
    edges = [p for p in range(1 << 16) if inside[p] != (p > 0 and inside[p - 1])]
    return "".join(f"\\u{a:04x}-\\u{b - 1:04x}" for a, b in zip(edges[::2], edges[1::2], strict=False))


#: Letters and marks of 16 bits, which hold all letters of classes; such a class is looked up in a bitmap.
TOKEN = re.compile(f"[{_runs('LM')}]+")


@cache
def plain_forms() -> dict[int, str]:
    """Code points that look like a plain form, by the Unicode data; blanks to one blank, invisible characters to none."""
    table: dict[int, str] = {}
    drawn = set("".join(CLASSES))
    for point in range(sys.maxunicode + 1):
        char = chr(point)
        kind = unicodedata.category(char)
        if kind in ("Cf", "Cc", "Cs") or char in FILLERS or 0xFE00 <= point <= 0xFE0F or 0xE0100 <= point <= 0xE01EF:
            if char not in "\t\n\r":
                table[point] = "\n" if char in "\x0b\x0c\x85" else ""
        elif kind == "Zs" or char == "⠀":
            table[point] = " "
        elif kind in ("Zl", "Zp"):
            table[point] = "\n"
        elif (form := unicodedata.decomposition(char)) and form.startswith(KINDS) and char != "ſ" and char not in drawn:
            table[point] = unicodedata.normalize("NFKD", char)
    table[ord("\t")] = " "
    return table


_JOINED = regex.compile(r"(?<=\p{So})‍(?=\p{So})")


def plain(text: str) -> str:
    """Plain forms for the few different characters of a text that have one; whole texts are not walked in Python."""
    table = plain_forms()
    for char in set(text):
        if ord(char) in table:
            text = text.replace(char, table[ord(char)])
    return text


def normalise(text: str) -> str:
    """Decomposed (NFD) text with plain forms only; blanks at the ends of lines and of the text dropped."""
    if not text.isascii():
        keep = "‍" in text and _JOINED.search(text)
        text = "‍".join(map(plain, _JOINED.split(text))) if keep else plain(text)
        text = unicodedata.normalize("NFD", text)
    elif not text.isprintable():
        text = text.translate({p: s for p, s in plain_forms().items() if p < 128} | {13: "\r"})
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    if "  " in text:
        text = regex.sub(" +", " ", text)
    if " \n" in text or "\n " in text:
        text = regex.sub(" *\n *", "\n", text)
    return text.strip(" \n")


@cache
def classes() -> tuple[dict[str, str], dict[str, str]]:
    """Letter -> first member of its class; first member -> class."""
    return {c: k[0] for k in CLASSES for c in k}, {k[0]: k for k in CLASSES}


@cache
def near() -> dict[str, str]:
    """First member of a class, or a letter of none -> the first members that are near it."""
    first, out = classes()[0], {}
    for k in NEAR:
        for c in k[1:]:
            for x, y in ((k[0], c), (c, k[0])):
                x, y = first.get(x, x), first.get(y, y)
                out[x] = out.get(x, "") + y
    return out


def shape_of(text: str) -> str:
    """The text with the first member of its class for every letter."""
    if not text.isascii():
        first = classes()[0]
        for char in set(text):
            if first.get(char, char) != char:
                text = text.replace(char, first[char])
    return text


@cache
def script(char: str) -> str:
    """Latin, Cyrillic, Greek, Armenian, another script's first letter of its name, or '' for marks."""
    if unicodedata.category(char).startswith("M"):
        return ""
    return unicodedata.name(char, "?").split(" ")[0].title()


MODELLED = ("Latin", "Cyrillic", "Greek", "Armenian")


def divided(shape: str) -> bool:
    """Whether no choice of class members reads the token in one script."""
    members, common = classes()[1], None
    for c in shape:
        own = {script(m) for m in members.get(c, c)}
        if "" not in own:
            common = own if common is None else common & own
            if not common:
                return True
    return False


def count_bigrams(tokens: Counter, total: Counter) -> None:
    """Adds the (script, a, b) of the single-script tokens; '^' and '$' are a token's ends."""
    for token, n in tokens.items():
        scripts = {script(c) for c in token} - {""}
        if len(scripts) == 1 and (own := scripts.pop()) in MODELLED:
            chars = ["^", *token, "$"]
            for a, b in zip(chars, chars[1:], strict=False):
                total[own, a, b] += n


def bigrams(df: DataFrame, text: str = "text") -> DataFrame:
    """(script, a, b, n) over the single-script tokens of all texts.

    At most (letters and marks of the four scripts)^2 rows, whatever the size of the corpus; each task counts before
    the shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            tokens: Counter = Counter()
            for t in batch.column(0):
                tokens.update(TOKEN.findall(normalise(t.as_py())))
            count_bigrams(tokens, total)
        rows = list(total.items())
        yield pa.RecordBatch.from_pydict({"script": [k[0] for k, _ in rows], "a": [k[1] for k, _ in rows], "b": [k[2] for k, _ in rows], "n": [v for _, v in rows]},
            schema=pa.schema([("script", pa.string()), ("a", pa.string()), ("b", pa.string()), ("n", pa.int64())]))

    texts = df.where(F.col(text).isNotNull()).select(text)
    return texts.mapInArrow(run, "script string, a string, b string, n bigint").groupBy("script", "a", "b").agg(F.sum("n").alias("n"))


class Reader:
    """The consistent form of tokens and texts under a bigram model (rows of :func:`bigrams`)."""

    def __init__(self, model: list[tuple[str, str, str, int]]):
        sums: Counter = Counter()
        for own, a, _, n in model:
            sums[own, a] += n
        self.cost = {(own, a, b): -math.log(n / sums[own, a]) for own, a, b, n in model}
        self.first, self.members = classes()
        self.kept: dict[str, str] = {}  # by shape
        self.seen: dict[str, str] = {}  # by token as it stands

    def _step(self, own: str, a: str, b: str) -> float:
        return self.cost.get((own, a, b), UNSEEN)

    def token(self, token: str) -> str:
        shape = shape_of(token)
        got = self.kept.get(shape)
        if got is None:
            if len(self.kept) >= KEPT:
                self.kept.clear()
            got = self.kept[shape] = self.viterbi(shape)
        return got

    def options(self, shape: str) -> list[list[tuple[str, float]]]:
        """The letters that may stand at each place with their prices."""
        other = near() if divided(shape) else {}
        out = []
        for c in shape:
            alike = [(m, 0.0) for m in self.members.get(c, c)]
            out.append(alike + [(m, NEARLY) for x in other.get(c, "") for m in self.members.get(x, x)])
        return out

    def viterbi(self, shape: str) -> str:
        """The best path through the lattice of a shape (first members of classes and other letters)."""
        # state: (script so far, last char) -> (cost, path)
        states: dict[tuple[str, str], tuple[float, str]] = {("", "^"): (0.0, "")}
        for place in self.options(shape):
            following: dict[tuple[str, str], tuple[float, str]] = {}
            for option, extra in place:
                own = script(option)
                for (was, a), (cost, path) in states.items():
                    now = own or was
                    price = cost + extra + self._step(now, a, option) + (SWITCH if was and own and own != was else 0.0)
                    if (now, option) not in following or price < following[now, option][0]:
                        following[now, option] = (price, path + option)
            states = following
        return min(states.items(), key=lambda x: x[1][0] + self._step(x[0][0], x[0][1], "$"))[1][1]

    def resolved(self, shape: str) -> str:
        """The shape of a text's best paths, given the text's shape."""
        return TOKEN.sub(lambda m: shape_of(self.token(m[0])) if divided(m[0]) else m[0], shape)

    def text(self, text: str) -> str:
        seen = self.seen
        if len(seen) > KEPT:
            seen.clear()
        form = normalise(text)
        for token in TOKEN.findall(form):
            if token not in seen:
                seen[token] = self.token(token)
        return unicodedata.normalize("NFC", TOKEN.sub(lambda m: seen[m[0]], form))


@lru_cache(maxsize=2)
def reader_of(model: tuple[tuple[str, str, str, int], ...]) -> Reader:
    """One per model and Python worker, so later tasks find the tokens of earlier ones."""
    return Reader(list(model))


def model_rows(df: DataFrame) -> list[tuple[str, str, str, int]]:
    """The bigram model on the driver: bounded by the alphabets of four scripts."""
    return sorted((r["script"], r["a"], r["b"], r["n"]) for r in bigrams(df).collect())


def consistent_text(df: DataFrame, key: str = "doc_id", text: str = "text", model: list | None = None) -> DataFrame:
    """(key, text): the consistent form of every text, null for null."""
    model = model_rows(df) if model is None else model
    reader = df.sparkSession.sparkContext.broadcast(tuple(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = reader_of(reader.value)
        for batch in batches:
            forms = [None if (t := x.as_py()) is None else own.text(t) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(forms, pa.string())], names=[key, text])

    return df.select(key, text).mapInArrow(run, f"{key} {dict(df.dtypes)[key]}, {text} string")


def _digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


_SEEN = pa.schema([("doc_id", pa.int64()), ("raw", pa.binary()), ("form", pa.binary()), ("shape", pa.string()), ("script", pa.string()), ("a", pa.string()), ("b", pa.string()), ("n", pa.int64())])


def seen_texts(df: DataFrame) -> DataFrame:
    """The one pass over the corpus: (doc_id, raw, form) of every text, with ``shape`` instead of the form's digest where a token is divided between scripts, and
    beside them the counted bigrams (script, a, b, n) of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        whole: set[str] = set()
        for batch in batches:
            tokens: Counter = Counter()
            rows = {name: [] for name in ("doc_id", "raw", "form", "shape")}
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = x.as_py()
                plain_text = normalise(raw)
                if not plain_text:
                    continue
                found = TOKEN.findall(plain_text)
                tokens.update(found)
                shape, open_ = shape_of(plain_text), False
                if not shape.isascii():
                    for token in set(TOKEN.findall(shape)) - whole:
                        if divided(token):
                            open_ = True
                        elif len(whole) < KEPT:
                            whole.add(token)
                for name, value in (("doc_id", i), ("raw", _digest(raw)), ("form", None if open_ else _digest(shape)), ("shape", shape if open_ else None)):
                    rows[name].append(value)
            count_bigrams(tokens, total)
            yield pa.RecordBatch.from_pydict(rows | {name: [None] * len(rows["raw"]) for name in ("script", "a", "b", "n")}, schema=_SEEN)
        keys = list(total)
        counts = {"script": [k[0] for k in keys], "a": [k[1] for k in keys], "b": [k[2] for k in keys], "n": [total[k] for k in keys]}
        yield pa.RecordBatch.from_pydict({name: [None] * len(keys) for name in ("doc_id", "raw", "form", "shape")} | counts, schema=_SEEN)

    rows = df.where("doc_id is not null and text is not null").select("doc_id", "text")
    return rows.mapInArrow(run, "doc_id bigint, raw binary, form binary, shape string, script string, a string, b string, n bigint")


def lookalike_pairs(df: DataFrame) -> DataFrame:
    """(doc_a, doc_b), doc_a < doc_b: all pairs of (doc_id, text) that look the same but are not equal as stored.

    Digests of 128 bits stand for the forms and the stored texts. Equal stored texts are one variant; only forms with two or
    more variants are joined, variant against other variant, then by their documents: no pair of equal texts is made
    on the way, so a text that fills a third of the rows costs its true pairs only, and its documents are spread over blocks.
    """
    seen = cut(seen_texts(df))
    counts = seen.where("script is not null").groupBy("script", "a", "b").agg(F.sum("n").alias("n")).collect()
    model = df.sparkSession.sparkContext.broadcast(tuple(sorted((r["script"], r["a"], r["b"], r["n"]) for r in counts)))

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = reader_of(model.value)
        for batch in batches:
            forms = [_digest(own.resolved(x.as_py())) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(forms, pa.binary())], names=["doc_id", "raw", "form"])

    closed = seen.where("form is not null").select("doc_id", "raw", "form")
    opened = seen.where("shape is not null").select("doc_id", "raw", "shape").mapInArrow(resolve, "doc_id bigint, raw binary, form binary")
    digests = cut(closed.unionByName(opened).distinct())
    variants = cut(digests.select("form", "raw").distinct())
    several = variants.groupBy("form").agg(F.count("*").alias("n")).where("n > 1").select("form")
    several = variants.join(several, "form", "left_semi").select("form", "raw")
    pairs = several.join(several.select("form", F.col("raw").alias("raw_b")), "form").where("raw < raw_b").select("raw", "raw_b")
    large = hot.large_keys(digests.select("raw"), "raw", BLOCK)
    members = digests.join(several.select("raw").distinct(), "raw", "left_semi").select("raw", "doc_id")
    members = hot.in_blocks(members, "raw", "doc_id", large)
    left = hot.to_blocks(pairs, "raw", large).join(members, ["raw", "_block"]).select("raw_b", F.col("doc_id").alias("x"))
    right = members.select(F.col("raw").alias("raw_b"), "_block", F.col("doc_id").alias("y"))
    both = hot.to_blocks(left, "raw_b", large).join(right, ["raw_b", "_block"])
    return both.where("x <> y").select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b")).distinct()
