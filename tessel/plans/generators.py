"""Synthetic questions over named numbers, shares and dates (G10): every row of a table gives one example of each kind, by seeded draws of its key.

An example is (key, question, answer, context): the context assigns values to 29 names in a drawn order, those of the question among them. Numbers are kept in hundredths,
dates as days before a fixed day, so both engines compute with integers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.catalog import query
from tessel.functions import sql as S
from tessel.functions import text as T
from tessel.operators.builders import draw
from tessel.sources.tables import table

# The wordings of the questions.
MOST = ["longest", "last", "highest", "largest", "most", "greatest"]
LEAST = ["shortest", "first", "smallest", "lowest", "least"]
ARG_MOST = ["highest", "largest", "biggest", "maximum", "greatest"]
ARG_LEAST = ["minimum", "smallest", "lowest", "least"]
LATEST = ["last", "latest", "most recent", "youngest"]
EARLIEST = ["first", "earliest", "oldest", "least recent"]
LESS = ["fewer than", "less than", "before", "earlier than", "smaller than", "lower than", "<"]
MORE = ["more than", "later than", "bigger than", "higher than", ">", "larger than", "greater than"]
DATE_LESS = ["before", "earlier than", "older than", "<"]
DATE_MORE = ["after", "later than", "younger than", ">"]
#: Names of values, single and doubled letters, and of things; both may be replaced.
NAMES = [chr(97 + i) * n for n in (1, 2) for i in range(26)]
THINGS = "river tower apple stone lamp horse cloud bridge flute garden mirror anchor candle basket window feather island kettle ladder marble needle orchid pepper ribbon".split()
VALUES, MOST_NUMBER, DAYS, TODAY = 29, 20_000, 2018 * 365, "2020-01-01"


def _int(below: Column | int, seed: int, *key: Column | str) -> Column:
    return F.floor(draw(seed, *key) * below).cast("int")


def _pick(words: list[str], seed: int, *key: Column | str) -> Column:
    return F.element_at(F.array(*[F.lit(w) for w in words]), _int(len(words), seed, *key) + 1)


def _upto(n: Column | int) -> Column:
    return F.sequence(F.lit(0), (n if isinstance(n, Column) else F.lit(n)) - 1)


def number_text(hundredths: Column) -> Column:
    """-1250 as -12.5"""
    size, sign = F.abs(hundredths), F.when(hundredths < 0, "-").otherwise("")
    whole, part = F.floor(size / 100).cast("bigint").cast("string"), F.lpad((size % 100).cast("int").cast("string"), 2, "0")
    return F.concat(sign, whole, F.when(size % 100 == 0, "").otherwise(F.concat(F.lit("."), F.regexp_replace(part, "0$", ""))))


def date_text(days: Column, seed: int, *key: Column | str) -> Column:
    """Days before the fixed day as '02 October 736' or 'October 02, 736'."""
    d = F.date_sub(F.lit(TODAY).cast("date"), days)
    day, month, year = F.lpad(F.day(d).cast("string"), 2, "0"), F.date_format(d, "MMMM"), F.year(d).cast("string")
    return F.when(draw(seed, *key) < 0.5, F.concat(day, F.lit(" "), month, F.lit(" "), year)).otherwise(F.concat(month, F.lit(" "), day, F.lit(", "), year))


def _number(seed: int, key: str, i: Column) -> Column:
    """Hundredths below 20,000, with none, one or two places."""
    places = draw(seed + 1, key, i)
    part = F.when(places < 0.2, 0).when(places < 0.6, 10 * _int(10, seed + 2, key, i)).otherwise(_int(100, seed + 2, key, i))
    return 100 * _int(MOST_NUMBER, seed, key, i) + part


def _days(key: str, i: Column) -> Column:
    """Three of four dates lie near the first: within 30 or 150 days."""
    near = F.when(draw(41, key) < 0.5, 30).otherwise(150)
    shift = (1 + _int(near, 42, key, i)) * F.when(draw(43, key, i) < 0.5, -1).otherwise(1)
    return F.when(i == 0, 200 + _int(DAYS - 400, 40, key)).otherwise(200 + _int(DAYS - 400, 40, key) + shift)


def with_names(df: DataFrame, key: str) -> DataFrame:
    """Adds ``names``: the names of values in an order drawn for the row."""
    order = F.transform(F.array(*[F.lit(v) for v in NAMES]), lambda v, i: F.struct(draw(10, key, i).alias("d"), v.alias("v")))
    return df.withColumn("names", F.slice(F.transform(F.array_sort(order), lambda t: t["v"]), 1, VALUES))


def with_context(df: DataFrame, key: str, values: Column, other) -> DataFrame:
    """Adds ``context``: the texts of ``values`` and then of ``other``(i) assigned to the names, in a drawn order."""
    filled = T.let(values, lambda v: F.concat(v, F.transform(F.sequence(F.size(v), F.lit(VALUES - 1)), other)))
    stated = F.transform(F.arrays_zip(F.col("names").alias("v"), filled.alias("x")), lambda p, i: F.struct(draw(11, key, i).alias("d"), F.concat(p["v"], F.lit(" = "), p["x"], F.lit(" ;")).alias("t")))
    return df.withColumn("context", F.array_join(F.transform(F.array_sort(stated), lambda t: t["t"]), " "))


def _examples(spark: SparkSession, path: str) -> DataFrame:
    return with_names(table(spark, path, "customer").select("c_custkey"), "c_custkey")


def _numbers(df: DataFrame, key: str = "c_custkey") -> DataFrame:
    """Adds ``x``, two to four numbers in hundredths, all whole for every second row, and the context."""
    broken = draw(2, key) < 0.5
    one = lambda i: F.when(broken, _number(3, key, i)).otherwise(100 * _int(MOST_NUMBER, 3, key, i))
    rows = df.withColumn("x", F.transform(_upto(2 + _int(3, 1, key)), one))
    return with_context(rows, key, F.transform("x", number_text), lambda i: number_text(_number(6, key, i)))


def _name(i: int) -> Column:
    return F.get("names", F.lit(i))


def _listed(n: Column) -> Column:
    return F.array_join(F.slice(F.col("names"), F.lit(1), n), ", ")


def _between(key: str, less: list[str], more: list[str]) -> tuple[Column, Column]:
    """Question and answer about the first two or three of ``x``."""
    x = lambda i: F.get("x", F.lit(i))
    fewer = draw(33, key) < 0.5
    word = F.when(fewer, _pick(less, 34, key)).otherwise(_pick(more, 34, key))
    start = F.when(draw(32, key) < 0.5, "Is ").otherwise("")
    two = F.concat(start, _name(0), F.lit(" "), word, F.lit(" "), _name(1), F.lit("?"))
    three = F.concat(start, _name(0), F.lit(" between "), _name(1), F.lit(" and "), _name(2), F.lit("?"))
    inside = ((x(0) >= x(1)) & (x(0) <= x(2))) | ((x(0) >= x(2)) & (x(0) <= x(1)))
    true = F.when(F.size("x") == 3, inside).when(fewer, x(0) < x(1)).otherwise(x(0) > x(1))
    return F.when(F.size("x") == 3, three).otherwise(two), F.when(true, "yes").otherwise("no")


# --- the same examples in SQL
_NUM = lambda c: f"(case when {c} < 0 then '-' else '' end || cast(abs({c}) // 100 as varchar) || case when abs({c}) % 100 = 0 then '' else '.' || regexp_replace(lpad(cast(abs({c}) % 100 as varchar), 2, '0'), '0$', '') end)"
_I = lambda below, seed, *key: f"cast(floor({S.draw(seed, *key)} * {below}) as integer)"
_ANY = lambda words, seed, *key: f"[{', '.join(S.quote(w) for w in words)}][{_I(len(words), seed, *key)} + 1]"
_K = "c_custkey"


def _number_sql(seed: int, i: str) -> str:
    places = S.draw(seed + 1, _K, i)
    return f"(100 * {_I(MOST_NUMBER, seed, _K, i)} + case when {places} < 0.2 then 0 when {places} < 0.6 then 10 * {_I(10, seed + 2, _K, i)} else {_I(100, seed + 2, _K, i)} end)"


def _date_sql(days: str, seed: int, i: str) -> str:
    d = f"(date '{TODAY}' - cast({days} as integer))"
    day, month, year = f"lpad(cast(day({d}) as varchar), 2, '0')", f"monthname({d})", f"cast(year({d}) as varchar)"
    return f"(case when {S.draw(seed, _K, i)} < 0.5 then {day} || ' ' || {month} || ' ' || {year} else {month} || ' ' || {day} || ', ' || {year} end)"


def _days_sql(i: str) -> str:
    shift = f"(1 + {_I(f'case when {S.draw(41, _K)} < 0.5 then 30 else 150 end', 42, _K, i)}) * case when {S.draw(43, _K, i)} < 0.5 then -1 else 1 end"
    return f"(200 + {_I(DAYS - 400, 40, _K)} + case when {i} = 0 then 0 else {shift} end)"


def _with_sql(x: str, text: str, other: str) -> str:
    """CTEs: e (c_custkey, names, x), c (c_custkey, context). ``x`` is the list, ``text`` that of y at i, ``other`` of a value at i."""
    return f"""n as (select c_custkey, list(v order by d, v)[1:{VALUES}] as names from (select c_custkey, v, {S.draw(10, _K, "i")} as d from (select c_custkey, unnest({NAMES}) as v, unnest(range(0, {len(NAMES)})) as i from customer)) group by c_custkey),
e as (select c_custkey, names, {x} as x from n),
f as (select c_custkey, names, list_concat(list_transform(x, lambda y, j: {text.replace("@i", "(j - 1)").replace("@y", "y")}), list_transform(range(len(x), {VALUES}), lambda i: {other.replace("@i", "i")})) as t from e),
c as (select c_custkey, string_agg(v || ' = ' || t || ' ;', ' ' order by {S.draw(11, _K, "i")}, v) as context from (select c_custkey, unnest(names) as v, unnest(t) as t, unnest(range(0, {VALUES})) as i from f) group by c_custkey)"""


_NUMBERS = _with_sql(
    f"list_transform(range(0, 2 + {_I(3, 1, _K)}), lambda i: case when {S.draw(2, _K)} < 0.5 then {_number_sql(3, 'i')} else 100 * {_I(MOST_NUMBER, 3, _K, 'i')} end)",
    _NUM("@y"), _NUM(_number_sql(6, "@i")),
)
_LIST = "array_to_string(names[1:len(x)], ', ')"
_SIGN = S.draw(20, _K, "i - 1")


@query(f"""with {_NUMBERS} select c_custkey, 'What is ' || regexp_replace(array_to_string(list_transform(x, lambda y, i: case when {_SIGN} < 0.5 then '+ ' else '- ' end || names[i]), ' '), '^[+] ', '') || '?' as question,
 {_NUM(f"list_sum(list_transform(x, lambda y, i: case when {_SIGN} < 0.5 then y else -y end))")} as answer, context from e join c using (c_custkey)""")
def g10_signed_arithmetic(spark: SparkSession, path: str) -> DataFrame:
    """What is a - b + c?"""
    rows = _numbers(_examples(spark, path))
    plus = lambda i: draw(20, "c_custkey", i) < 0.5
    terms = F.array_join(F.transform("x", lambda y, i: F.concat(F.when(plus(i), "+ ").otherwise("- "), F.get("names", i))), " ")
    total = F.aggregate(F.transform("x", lambda y, i: F.when(plus(i), y).otherwise(-y)), F.lit(0), lambda s, y: s + y)
    return rows.select("c_custkey", F.concat(F.lit("What is "), F.regexp_replace(terms, r"^\+ ", ""), F.lit("?")).alias("question"), number_text(total).alias("answer"), "context")


@query(f"""with {_NUMBERS} select c_custkey, 'What is the ' || case {_I(3, 21, _K)} when 0 then {_ANY(MOST, 22, _K)} when 1 then {_ANY(LEAST, 22, _K)} else 'average' end || ' of ' || {_LIST} || '?' as question,
 {_NUM(f"cast(case {_I(3, 21, _K)} when 0 then list_max(x) when 1 then list_min(x) else round(list_sum(x) * 1.0::double / len(x)) end as bigint)")} as answer, context from e join c using (c_custkey)""")
def g10_min_max_average(spark: SparkSession, path: str) -> DataFrame:
    """What is the greatest of a, b?"""
    rows, kind = _numbers(_examples(spark, path)), _int(3, 21, "c_custkey")
    word = F.when(kind == 0, _pick(MOST, 22, "c_custkey")).when(kind == 1, _pick(LEAST, 22, "c_custkey")).otherwise("average")
    mean = F.round(F.aggregate("x", F.lit(0), lambda s, y: s + y) / F.size("x")).cast("bigint")
    value = F.when(kind == 0, F.array_max("x")).when(kind == 1, F.array_min("x")).otherwise(mean)
    return rows.select("c_custkey", F.concat(F.lit("What is the "), word, F.lit(" of "), _listed(F.size("x")), F.lit("?")).alias("question"), number_text(value).alias("answer"), "context")


@query(f"""with {_NUMBERS}, w as (select *, list_transform(x, lambda y, i: [{', '.join(S.quote(t) for t in THINGS)}][{_I(len(THINGS), 24, _K, "i - 1")} + 1]) as things, {S.draw(23, _K)} < 0.5 as most from e)
select c_custkey, 'What is the element with ' || case when most then {_ANY(ARG_MOST, 25, _K)} else {_ANY(ARG_LEAST, 25, _K)} end || ' value of: ' || array_to_string(list_transform(things, lambda t, i: t || ' ' || names[i]), ', ') || '?' as question,
 things[list_position(x, case when most then list_max(x) else list_min(x) end)] as answer, context from w join c using (c_custkey)""")
def g10_arg_extreme(spark: SparkSession, path: str) -> DataFrame:
    """What is the element with highest value of: lamp a, horse b?"""
    things = F.transform("x", lambda y, i: _pick(THINGS, 24, "c_custkey", i))
    rows, most = _numbers(_examples(spark, path)).withColumn("things", things), draw(23, "c_custkey") < 0.5
    word = F.when(most, _pick(ARG_MOST, 25, "c_custkey")).otherwise(_pick(ARG_LEAST, 25, "c_custkey"))
    listed = F.array_join(F.transform("things", lambda t, i: F.concat(t, F.lit(" "), F.get("names", i))), ", ")
    at = F.array_position("x", F.when(most, F.array_max("x")).otherwise(F.array_min("x"))).cast("int")
    return rows.select("c_custkey", F.concat(F.lit("What is the element with "), word, F.lit(" value of: "), listed, F.lit("?")).alias("question"), F.element_at("things", at).alias("answer"), "context")


_SHARES = _with_sql(
    f"(with w as (select list_transform(range(0, 3 + {_I(3, 50, _K)}), lambda i: 1 + {_I(99, 51, _K, 'i')}) as w), r as (select list_transform(w[2:], lambda y: cast(floor(10000 * y / list_sum(w)) as integer)) as r from w) select list_concat([10000 - list_sum(r)], r) from r)",
    _NUM("@y") + " || '%'", _NUM(f"(100 * {_I(101, 52, _K, '@i')})") + " || '%'",
)
_ASKED = f"least(1 + {_I(3, 53, _K)}, len(x) - 1)"


@query(f"""with {_SHARES}, w as (select *, list_transform(x, lambda y, i: [{', '.join(S.quote(t) for t in THINGS)}][{_I(len(THINGS), 54, _K, "i - 1")} + 1]) as things, {_ASKED} as asked, {S.draw(55, _K)} < 0.5 as without from e)
select c_custkey, 'What percentage is ' || case when without then 'not ' else '' end || array_to_string(things[1:asked], ', ') || ' of: ' || array_to_string(list_transform(things, lambda t, i: t || ' ' || names[i]), ', ') || '?' as question,
 {_NUM("cast(case when without then 10000 - list_sum(x[1:asked]) else list_sum(x[1:asked]) end as bigint)")} as answer, context from w join c using (c_custkey)""")
def g10_percentage(spark: SparkSession, path: str) -> DataFrame:
    """What percentage is not lamp of: lamp a, horse b, cloud c? The shares sum to a hundred."""
    key = "c_custkey"
    weights = F.transform(_upto(3 + _int(3, 50, key)), lambda i: 1 + _int(99, 51, key, i))
    total = lambda w: F.aggregate(w, F.lit(0), lambda s, y: s + y)
    rest = T.let(weights, lambda w: F.transform(F.slice(w, F.lit(2), F.size(w)), lambda y: F.floor(10000 * y / total(w)).cast("int")))
    rows = _examples(spark, path).withColumn("x", T.let(rest, lambda r: F.concat(F.array(F.lit(10000) - total(r)), r)))
    percent = lambda y: F.concat(number_text(y), F.lit("%"))
    rows = with_context(rows, key, F.transform("x", percent), lambda i: percent(100 * _int(101, 52, key, i)))
    rows = rows.withColumn("things", F.transform("x", lambda y, i: _pick(THINGS, 54, key, i))).withColumn("asked", F.least(1 + _int(3, 53, key), F.size("x") - 1))
    without, part = draw(55, key) < 0.5, total(F.slice(F.col("x"), F.lit(1), F.col("asked")))
    listed = F.array_join(F.transform("things", lambda t, i: F.concat(t, F.lit(" "), F.get("names", i))), ", ")
    chosen = F.array_join(F.slice(F.col("things"), F.lit(1), F.col("asked")), ", ")
    question = F.concat(F.lit("What percentage is "), F.when(without, "not ").otherwise(""), chosen, F.lit(" of: "), listed, F.lit("?"))
    return rows.select(key, question.alias("question"), number_text(F.when(without, 10000 - part).otherwise(part)).alias("answer"), "context")


def _dates_sql(n: str) -> str:
    return _with_sql(f"list_transform(range(0, {n}), lambda i: {_days_sql('i')})", _date_sql("@y", 44, "@i"), _date_sql(f"(200 + {_I(DAYS - 400, 45, _K, '@i')})", 44, "@i"))


def _dates(df: DataFrame, n: Column | int, key: str = "c_custkey") -> DataFrame:
    """Adds ``x``, dates as days before the fixed day, and the context."""
    rows = df.withColumn("x", F.transform(_upto(n), lambda i: _days(key, i)))
    return with_context(rows, key, F.transform("x", lambda y, i: date_text(y, 44, key, i)), lambda i: date_text(200 + _int(DAYS - 400, 45, key, i), 44, key, i))


@query(f"""with {_dates_sql("3")}, w as (select *, {S.draw(26, _K)} < 0.5 as latest from e), p as (select *, list_position(x, case when latest then list_min(x) else list_max(x) end) as p from w)
select c_custkey, 'What is the ' || case when latest then {_ANY(LATEST, 27, _K)} else {_ANY(EARLIEST, 27, _K)} end || ' of: ' || {_LIST} || '?' as question, {_date_sql("x[p]", 44, "p - 1")} as answer, context from p join c using (c_custkey)""")
def g10_date_extreme(spark: SparkSession, path: str) -> DataFrame:
    """What is the latest of: a, b, c?"""
    key = "c_custkey"
    rows, latest = _dates(_examples(spark, path), 3), draw(26, key) < 0.5
    word = F.when(latest, _pick(LATEST, 27, key)).otherwise(_pick(EARLIEST, 27, key))
    rows = rows.withColumn("p", F.array_position("x", F.when(latest, F.array_min("x")).otherwise(F.array_max("x"))).cast("int"))
    question = F.concat(F.lit("What is the "), word, F.lit(" of: "), _listed(F.size("x")), F.lit("?"))
    return rows.select(key, question.alias("question"), date_text(F.element_at("x", F.col("p")), 44, key, F.col("p") - 1).alias("answer"), "context")


_DAY = lambda c: f"(date '{TODAY}' - cast({c} as integer))"


@query(f"""with {_dates_sql("2")}, w as (select *, {_I(3, 28, _K)} as kind, {_DAY("list_min(x)")} as late, {_DAY("list_max(x)")} as early from e)
select c_custkey, 'What is the difference in ' || ['years', 'months', 'days'][kind + 1] || ' of ' || {_LIST} || '?' as question,
 cast(case kind when 0 then year(late) - year(early) when 1 then 12 * (year(late) - year(early)) + month(late) - month(early) else list_max(x) - list_min(x) end as varchar) as answer, context from w join c using (c_custkey)""")
def g10_date_difference(spark: SparkSession, path: str) -> DataFrame:
    """What is the difference in months of a, b? Years and months by the calendar's numbers, days by the days between."""
    key = "c_custkey"
    rows, kind = _dates(_examples(spark, path), 2), _int(3, 28, key)
    late, early = (F.date_sub(F.lit(TODAY).cast("date"), f("x")) for f in (F.array_min, F.array_max))
    years = F.year(late) - F.year(early)
    value = F.when(kind == 0, years).when(kind == 1, 12 * years + F.month(late) - F.month(early)).otherwise(F.array_max("x") - F.array_min("x"))
    unit = F.element_at(F.array(F.lit("years"), F.lit("months"), F.lit("days")), kind + 1)
    question = F.concat(F.lit("What is the difference in "), unit, F.lit(" of "), _listed(F.size("x")), F.lit("?"))
    return rows.select(key, question.alias("question"), value.cast("string").alias("answer"), "context")


def _between_sql(rows: str, less: list[str], more: list[str], sign: int) -> str:
    """``sign`` is -1 where a greater value is less, as with days before a fixed day."""
    lt, gt = ("<", ">") if sign > 0 else (">", "<")
    word = f"case when {S.draw(33, _K)} < 0.5 then {_ANY(less, 34, _K)} else {_ANY(more, 34, _K)} end"
    start = f"case when {S.draw(32, _K)} < 0.5 then 'Is ' else '' end"
    return f"""{rows} select c_custkey, {start} || case when len(x) = 3 then names[1] || ' between ' || names[2] || ' and ' || names[3] else names[1] || ' ' || {word} || ' ' || names[2] end || '?' as question,
 case when case when len(x) = 3 then x[1] between least(x[2], x[3]) and greatest(x[2], x[3]) when {S.draw(33, _K)} < 0.5 then x[1] {lt} x[2] else x[1] {gt} x[2] end then 'yes' else 'no' end as answer, context from e join c using (c_custkey)"""


_SIGNED = _with_sql(
    f"list_transform(range(0, least(2 + {_I(3, 1, _K)}, 2 + {_I(2, 31, _K)})), lambda i: case when {S.draw(30, _K, 'i')} < 0.5 then -1 else 1 end * case when {S.draw(2, _K)} < 0.5 then {_number_sql(3, 'i')} else 100 * {_I(MOST_NUMBER, 3, _K, 'i')} end)",
    _NUM("@y"), _NUM(_number_sql(6, "@i")),
)


@query(_between_sql(f"with {_SIGNED}", LESS, MORE, 1))
def g10_yes_no_numbers(spark: SparkSession, path: str) -> DataFrame:
    """Is a more than b? Is a between b and c? Numbers of either sign."""
    key = "c_custkey"
    one = lambda i: F.when(draw(30, key, i) < 0.5, -1).otherwise(1) * F.when(draw(2, key) < 0.5, _number(3, key, i)).otherwise(100 * _int(MOST_NUMBER, 3, key, i))
    rows = _examples(spark, path).withColumn("x", F.transform(_upto(F.least(2 + _int(3, 1, key), 2 + _int(2, 31, key))), one))
    rows = with_context(rows, key, F.transform("x", number_text), lambda i: number_text(_number(6, key, i)))
    question, answer = _between(key, LESS, MORE)
    return rows.select(key, question.alias("question"), answer.alias("answer"), "context")


@query(_between_sql(f"with {_dates_sql(f'2 + {_I(2, 31, _K)}')}", DATE_LESS, DATE_MORE, -1))
def g10_yes_no_dates(spark: SparkSession, path: str) -> DataFrame:
    """Is a earlier than b? Is a between b and c?"""
    key = "c_custkey"
    rows = _dates(_examples(spark, path), 2 + _int(2, 31, key))
    question, answer = _between(key, DATE_LESS, DATE_MORE)
    # values are days before a fixed day, so they are compared with their signs turned
    turned = rows.withColumn("x", F.transform("x", lambda y: -y))
    return turned.select(key, question.alias("question"), answer.alias("answer"), "context")
