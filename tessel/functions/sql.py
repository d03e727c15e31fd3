"""Fragments of oracle SQL, written from the definitions, shared by several queries."""

from __future__ import annotations

from tessel.functions.text import STOP_WORDS, WS

STOPS = "(" + ", ".join(f"'{w}'" for w in STOP_WORDS) + ")"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'))"


def words(x: str) -> str:
    return f"list_filter(string_split({squeeze(x)}, ' '), lambda w: w <> '')"


def replace_all(x: str, pairs) -> str:
    for old, new in pairs:
        x = f"replace({x}, {quote(old)}, {quote(new)})"
    return x


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'" if s.isprintable() else " || ".join(f"chr({ord(c)})" for c in s)


def close(x: str, ends: str = ".?!") -> str:
    return f"case when {x} = '' or contains('{ends}', right({x}, 1)) then {x} else {x} || '.' end"


def unescape(x: str) -> str:
    return replace_all(x, (("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")))


def draw(seed: int, *key: str) -> str:
    return f"(('0x' || substr(md5(concat_ws('|', {seed}, {', '.join(key)})), 1, 7))::bigint / 268435456::double)"


def numbers(texts: str) -> str:
    """CTEs that end in num (t, v): the values of the texts (t) of a table, digits or English number phrases, null where they are none."""
    from tessel.functions.udf import SCALES, number_words

    known = "MAP {" + ", ".join(f"'{w}': {v}" for w, v in number_words().items()) + "}"
    scales = "MAP {" + ", ".join(f"'{w}': {v}" for w, v in SCALES.items()) + "}"
    fold = f"""list_reduce(whole, lambda a, w: case when {known}[w] is not null then {{'t': a.t, 'c': a.c + {known}[w], 'seen': true, 'ok': a.ok}} when w = 'hundred' and a.c <> 0 then {{'t': a.t, 'c': a.c * 100, 'seen': a.seen, 'ok': a.ok}}
 when {scales}[w] is not null and a.c <> 0 then {{'t': a.t + a.c * {scales}[w], 'c': 0::bigint, 'seen': a.seen, 'ok': a.ok}} else {{'t': a.t, 'c': a.c, 'seen': a.seen, 'ok': false}} end, {{'t': 0::bigint, 'c': 0::bigint, 'seen': false, 'ok': true}})"""
    return rf"""n0 as (select distinct t, trim(replace(lower({strip("t")}), ',', ''), '.!?$%"' || chr(39)) as b from {texts} where t is not null),
n1 as (select t, b, array_to_string(list_filter(string_split_regex(replace(b, '-', ' '), '{WS}+'), lambda w: w not in ('', 'and')), ' ') as p from n0),
n2 as (select t, b, list_filter(string_split(case when instr(p, ' point ') > 0 then left(p, instr(p, ' point ') - 1) else p end, ' '), lambda w: w <> '') as whole, list_filter(string_split(case when instr(p, ' point ') > 0 then substr(p, instr(p, ' point ') + 7) else '' end, ' '), lambda w: w <> '') as decimals from n1),
n3 as (select t, b, {fold} as f, list_transform(decimals, lambda w: coalesce({known}[w], 10)) as d from n2),
num as (select t, case when regexp_full_match(b, '[+-]?([0-9]+(_[0-9]+)*\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?') then cast(b as double) when f.ok and f.seen and not list_bool_or(list_transform(d, lambda x: x > 9) || [false])
 then f.t + f.c + coalesce(list_sum(list_transform(d, lambda x, i: x / power(10, i))), 0) end as v from n3)"""


TOKENS = r"regexp_extract_all({}, '[\p{{L}}\p{{N}}\p{{M}}]+|[^\p{{Z}}\p{{C}}]')"
SQUAD = r"""trim(regexp_replace(regexp_replace(regexp_replace(lower({}), '[!-/:-@\[-`{{-~\x{{2047}}]', '', 'g'),
 '(^|\s)((a|an|the)(\s+|$))+', '\1', 'g'), '[\s\x{{a0}}]+', ' ', 'g'))"""
