from __future__ import annotations

import itertools
import math
import re
import string
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessel.functions import metrics as M
from tessel.functions import qa, udf
from tessel.functions import text as T
from tessel.operators import builders


def one(spark, value, build, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(build(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("build", "value", "expected"),
    [
        (T.squeeze, " a  b\t\nc ", "a b c"),
        (T.base_ten, "-123.45", "- 1 10e2 2 10e1 3 10e0 4 10e-1 5 10e-2"),
        (T.base_ten, "123", "1 10e2 2 10e1 3 10e0"),
        (T.format_sentence, "  hello   there ", "Hello there."),
        (T.format_sentence, "", ""),
        (T.convert_brackets, "a -LRB-b-RRB- -COLON-", "a (b) :"),
        (T.unescape, "A &amp; B &quot;c&quot;", 'A & B "c"'),
        (T.fix_number_spacing, "abc12, -3", "abc 12, -3"),
        (T.squeeze, None, None),
        (qa.reformat_title, "Heat_ (a_film) x (y)", "Heat_ a film: x (y)"),
        (lambda x: T.cloze_awb(x, F.lit("NOUN"), "WHO"), "The man NOUN ran.", "The man, WHO ran."),
        (lambda x: T.cloze_wba(x, F.lit("NOUN"), "Who"), "The man NOUN ran.", "Who ran, The man"),
        (lambda x: qa.restate(x, F.lit("blue")), "The sky is _ today? \\n (A) x", "The sky is blue today. \\n"),
        (lambda x: qa.restate(x, F.lit("rome")), "Where \\n ctx", "Where. Rome. ctx. \\n"),
        (lambda x: qa.example(x, F.lit(None).cast("string"), F.lit("b")), "who\tis it.", "whois it? \\n \tb"),
    ],
)
def test_text_vectors(spark, build, value, expected):
    assert one(spark, value, build) == expected


def test_options_and_parts(spark):
    assert one(spark, "(A) x. (B) y.", qa.options) == ["x.", "y."]
    assert one(spark, "(A) a (b) c (B) d", qa.options_by_token) == ["a (b) c", "d"]
    assert one(spark, "#!#ann b#!#ann c#!#", qa.answers) == ["ann b", "ann c"]
    p = one(spark, "Which? \\n (A) i (B) f", qa.parse)
    assert (p.q_only, p.mc_options, p.context) == ("Which?", "(A) i (B) f", "")
    assert one(spark, "only question", qa.parse).context is None
    d = one(spark, "x ## who? ann ## where is #1? rome", qa.decomposition)
    assert d.ans == "x" and [(s.q, s.a) for s in d.steps] == [("who?", "ann"), ("where is #1?", "rome")]
    r = one(spark, "It rains. So the answer is no; SO THE ANSWER IS yes.\nmore", qa.rationale)
    assert (r.text, r.answer) == ("It rains. So the answer is no;", "yes")


def test_tokens(spark):
    assert one(spark, ["12", "45", "Ġ678", "a1"], T.split_digits, "array<string>") == ["1", "2", "4", "5", "Ġ6", "7", "8", "a1"]
    assert one(spark, ["a", "b", "c"], lambda x: T.ngrams(x, 2), "array<string>") == ["a", "a b", "b", "b c", "c"]
    assert one(spark, [], lambda x: T.ngrams(x, 2), "array<string>") == []
    assert one(spark, "don't stop", T.simple_tokens) == ["don", "'", "t", "stop"]


def brute_squad(s):
    s = "".join(c for c in s.lower() if c not in string.punctuation)
    return " ".join(re.sub(r"\b(a|an|the)\b", " ", s).split())


def test_metrics_against_brute_force(spark):
    rng = np.random.default_rng(3)
    pool = ["the", "a", "cat", "Cat,", "dog", "1,234", "5", "5.0", "x-y", "é", "an"]
    pairs = [(" ".join(rng.choice(pool, rng.integers(0, 6))), " ".join(rng.choice(pool, rng.integers(0, 6)))) for _ in range(200)]
    df = spark.createDataFrame(pairs, "p string, g string")
    toks = lambda c: F.filter(F.split(M.squad(F.col(c)), " "), lambda w: w != "")
    got = df.select(M.squad(F.col("p")).alias("n"), M.token_f1(toks("p"), toks("g")).alias("f1")).collect()
    for (p, g), r in zip(pairs, got, strict=True):
        assert r.n == brute_squad(p)
        a, b = brute_squad(p).split(), brute_squad(g).split()
        same = sum((Counter(a) & Counter(b)).values())
        expected = float(a == b) if not a or not b else 2 * same / (len(a) + len(b))
        assert abs(r.f1 - expected) < 1e-9


def test_number_gate(spark):
    f1 = lambda p, g: spark.range(1).select(M.set_f1(M.drop_tokens(F.lit(p)), M.drop_tokens(F.lit(g))).alias("f")).first().f
    assert f1("5 yards", "5.0 yards") == 1.0
    assert f1("6 yards", "5 yards") == 0.0
    assert f1("1,234", "1234") == 1.0
    assert f1("a cat sat", "the cat") == 0.67


def test_number_words_and_sequences():
    assert [udf.words_to_number(x) for x in ("two hundred and five", "1,234", "three million", "two point five", "million", "cat", "")] == [205, 1234, 3_000_000, 2.5, None, None, None]
    n, at = udf.longest_common_run("the rain in spain", "rain in mexico")
    assert (n, at) == (8, 4)
    assert udf.longest_common_subsequence("the rain in spain".split(), "rain in mexico".split()) == 2


def test_udfs_on_nulls(spark):
    df = spark.createDataFrame([("Ünï", "x"), (None, None), ("", "")], "a string, b string")
    rows = df.select(udf.strip_accents("a").alias("s"), udf.nfd("a").alias("d"), udf.original_span("b", "a").alias("o"), udf.to_number("a").alias("n")).collect()
    assert [r.s for r in rows] == ["Uni", None, ""]


# Examples of the published algorithm, word and stem in turn.
PORTER = (
    "caresses caress ponies poni ties ti caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl "
    "sized size hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration "
    "valenci valenc hesitanci hesit digitizer digit radicalli radic differentli differ vileli vile analogousli analog vietnamization vietnam predication predic operator oper "
    "feudalism feudal decisiveness decis hopefulness hope callousness callous formaliti formal sensitiviti sensit sensibiliti sensibl triplicate triplic formative form "
    "formalize formal electriciti electr electrical electr hopeful hope goodness good revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop "
    "adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust dependent depend adoption adopt homologou homolog communism commun activate activ "
    "angulariti angular homologous homolog effective effect bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll a a is is generalizations gener oscillators oscil"
).split()


def test_porter_stems():
    for word, want in zip(PORTER[::2], PORTER[1::2], strict=True):
        assert udf.stem(word) == want, (word, udf.stem(word), want)


def test_best_assignment_against_all_orders():
    rng = np.random.default_rng(5)
    for _ in range(150):
        n, m = rng.integers(1, 6, 2)
        scores = rng.integers(0, 5, (n, m)).astype(float)
        got = udf.best_assignment(scores)
        assert len(got) == min(n, m) == len({i for i, _ in got}) == len({j for _, j in got})
        wide = scores if n <= m else scores.T
        best = max(sum(wide[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(wide.shape[1]), wide.shape[0]))
        assert sum(scores[i, j] for i, j in got) == best


def test_aligned_f1():
    spans = lambda *texts: [set(t.split()) for t in texts]
    assert udf.aligned_f1(spans("a b", "c"), spans("c", "a b")) == 1.0
    assert udf.aligned_f1(spans("a b"), spans("a b", "c")) == 0.5
    assert udf.aligned_f1(spans("3.0 yards"), spans("4.0 yards")) == 0.0  # the numbers differ
    assert udf.aligned_f1(spans("x 4.0"), spans("4.0 yards")) == 0.5
    assert udf.aligned_f1(spans("a b c d"), spans("a b")) == 0.67
    assert udf.aligned_f1([], []) == 0.0 and udf.aligned_f1([set()], [set()]) == 1.0


def test_self_bleu_and_soft_unique():
    same, other = "the cat sat on the mat".split(), "a dog ran far away home".split()
    assert udf.self_bleu([same, same]) == [pytest.approx(100), pytest.approx(100)] and udf.self_bleu([same, other]) == [0.0, 0.0]
    # one word of four and no pair in common, by hand: smoothed (1+1)/(4+1) and 1/(3+1)
    assert udf.bleu("a b c d".split(), ["a x y z".split()], smooth=True) == pytest.approx(100 * math.sqrt(2 / 5 * 1 / 4))
    # brevity against the shortest reference
    assert udf.bleu("a b".split(), ["a b c d".split(), "a b c".split()]) == pytest.approx(100 * math.exp(1 - 3 / 2))
    assert udf.bleu("a a a".split(), ["a a".split()], most=1) == pytest.approx(100 * 2 / 3)  # counts are clipped
    assert udf.bleu([], [same]) == 0.0 and udf.self_bleu([same]) == [0.0]
    assert udf.soft_unique([same, same, same, other, "one two three".split()]) in ([0, 3, 4], [1, 3, 4], [2, 3, 4], [1, 2, 3, 4])
    assert udf.soft_unique([same, same]) == [0, 1] and udf.soft_unique([]) == []


def test_penn_tokens():
    of = lambda t: [w for w, _, _ in udf.penn_tokens(t)]
    assert of("Mr. Smith can't pay $3,000.50 -- he said “no”…") == ["Mr.", "Smith", "ca", "n't", "pay", "$", "3,000.50", "--", "he", "said", "``", "no", "''", "..."]
    assert of("the U.S.A. well-known dog's cannot") == ["the", "U.S.A.", "well-known", "dog", "'s", "can", "not"]
    assert of("") == [] and [(a, b) for _, a, b in udf.penn_tokens("a  b")] == [(0, 1), (3, 4)]


def test_numbers_in_texts():
    assert udf.normalise_numbers("It took five days, 1,200 men and 3.5 tons in 1953 ") == "It took 5 days, 1200 men and 3.5 tons in 1953 "
    assert udf.normalise_numbers("-123.45 or 10", True) == "- 1 10e2 2 10e1 3 10e0 4 10e-1 5 10e-2 or 1 10e1 0 10e0"
    assert udf.normalise_numbers("million 7 - --") == "million 7 - --"


def test_joint_guard_and_draws(spark):
    df = spark.createDataFrame([("yes", "yes"), ("yes", "yes it is"), ("the red cat", "red cat sat"), ("", "x"), (None, "x")], "p string, g string")
    got = [tuple(r.h) for r in df.select(M.hotpot(F.col("p"), F.col("g")).alias("h")).collect()]
    assert got[:4] == [(1, 1.0, 1.0), (0, 0.0, 0.0), (0, 1.0, pytest.approx(2 / 3)), (0, 0.0, 0.0)]
    draws = [r.d for r in spark.range(2000).select(builders.draw(7, "id").alias("d")).collect()]
    assert abs(sum(draws) / 2000 - 0.5) < 0.03 and len(set(draws)) == 2000 and all(0 <= d < 1 for d in draws)


def test_evidence_sets_are_consolidated(spark):
    rows = [(1, 0, "A", 3, 0), (1, 1, "A", 1, 0), (1, 2, "B", 2, 0), (1, 3, "C", 5, 0), (1, 3, "C", 4, 1), (1, 4, "D", 1, 0), (1, 4, "E", 2, 1), (1, 4, "E", 0, 2)]
    df = spark.createDataFrame(rows, "uid bigint, n int, title string, label int, at int")
    got = {(r.title, tuple(r.labels), r.single) for r in builders.consolidate_evidence(df, "uid", "n", "title", "label", "at").collect()}
    assert got == {("A", (1, 3), True), ("B", (2,), True), ("C_vvv0", (5,), False), ("C_vvv1", (4,), False), ("D", (1,), False), ("E", (0, 2), False)}


def naive_subsequence(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def naive_run(a, b):
    best = (0, 0)
    for n in range(1, min(len(a), len(b)) + 1):
        held = {tuple(b[j : j + n]) for j in range(len(b) - n + 1)}
        found = [i for i in range(len(a) - n + 1) if tuple(a[i : i + n]) in held]
        if found:
            best = (n, found[0])
    return best


@given(st.text(alphabet="ab é😀", max_size=14), st.text(alphabet="ab é😀", max_size=14))
@settings(max_examples=200, deadline=None)
def test_common_parts_against_tables(a, b):
    assert udf.longest_common_subsequence(a, b) == naive_subsequence(a, b) == udf.longest_common_subsequence(list(b), list(a))
    assert udf.longest_common_run(a, b) == naive_run(a, b) == udf.longest_common_run(list(a), list(b))


def test_subword_offsets(spark):
    from tokenizers import Tokenizer

    from tessel.functions import subwords as W

    text = "[unused1] The réservoir of\tVaetiafou.  [unused1] Ends here [SEP] "
    got = spark.createDataFrame([(text,), ("",), (None,)], "t string").select(W.subwords(spark, "t").alias("x")).collect()
    x, coder = got[0].x, Tokenizer.from_file(W.TOKENIZER)
    assert x.words == ["[unused1]", "The", "réservoir", "of", "Vaetiafou.", "[unused1]", "Ends", "here", "[SEP]"]
    for i, word in enumerate(x.words):
        mine = [t for t, o in zip(x.tokens, x.owner, strict=True) if o == i]
        assert mine == ([word] if word in W.SPECIAL else coder.encode(word, add_special_tokens=False).tokens) and x.tokens[x.first[i]] == mine[0]
    assert [x.tokens[i] for i in x.starts] == ["[unused1]"] * 2 and x.owner == sorted(x.owner)
    assert got[1].x.words == [] and got[2].x.words is None


# Examples of the published English stemmer, word and stem in turn.
ENGLISH = (
    "consign consign consigned consign consigning consign consignment consign consist consist consisted consist consistency consist consistent consist consistently consist "
    "consisting consist consists consist consolation consol consolations consol consolatory consolatori console consol consoled consol consoles consol consolidate consolid "
    "consolidated consolid consolidating consolid consoling consol consolingly consol consols consol consonant conson consort consort consorted consort consorting consort "
    "conspicuous conspicu conspicuously conspicu conspiracy conspiraci conspirator conspir conspirators conspir conspire conspir conspired conspir conspiring conspir "
    "constable constabl constables constabl constance constanc constancy constanc constant constant knack knack knackeries knackeri knacks knack knag knag knave knave "
    "knaves knave knavish knavish kneaded knead kneading knead knee knee kneel kneel kneeled kneel kneeling kneel kneels kneel knees knee knell knell knelt knelt knew knew "
    "knick knick knif knif knife knife knight knight knightly knight knights knight knit knit knits knit knitted knit knitting knit knives knive knob knob knobs knob "
    "knock knock knocked knock knocker knocker knockers knocker knocking knock knocks knock knopp knopp knot knot knots knot generate generat generous generous skies sky dying die"
).split()


def test_snowball_stems(spark):
    for word, want in zip(ENGLISH[::2], ENGLISH[1::2], strict=True):
        assert udf.stem_english(word) == want, (word, udf.stem_english(word), want)
    assert udf.stem_english("generously") == "generous"
    assert udf.stem_english("it's") == "it" and udf.stem_english("sayings") == "say" and udf.stem_english("cries") == "cri" and udf.stem_english("ties") == "tie"
    got = spark.createDataFrame([(["Running", "flies"],), (None,)], "t array<string>").select(udf.stems("t", "snowball").alias("s")).collect()
    assert got[0].s == ["run", "fli"] and got[1].s is None


def test_number_phrases_in_both_engines(duck):
    """The Python parser and its SQL agree on phrases, digits and what is no number."""
    from tessel.functions import sql as S

    texts = (
        "five|twenty-one|two hundred and five|one million two thousand|three point one four|hundred|1,200|$3.5|-7|zero|point five|one point twelve|nan|1e5|two two|thousand five||and|six hundred thousand"
    ).split("|")
    values = ", ".join(f"({S.quote(t)})" for t in texts)
    got = dict(duck.sql(f"with texts as (select * from (values {values}) x(t)), {S.numbers('texts')} select t, v from num").fetchall())
    for t in texts:
        assert got[t] == pytest.approx(udf.words_to_number(t)) if got[t] is not None else udf.words_to_number(t) is None, t
    assert got["one million two thousand"] == 1_002_000 and got["hundred"] is None and got["three point one four"] == pytest.approx(3.14)
