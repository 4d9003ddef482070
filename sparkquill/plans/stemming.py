"""The stemmer as DuckDB SQL, step by step over a table of words: what the stem queries are compared with."""

from __future__ import annotations

from sparkquill.plans.expected import IRREGULAR, STEP2, STEP3, STEP4


def _shape(x: str) -> str:
    return f"list_reduce(string_split({x}, ''), lambda a, c: a || case when c in ('a', 'e', 'i', 'o', 'u') or (c = 'y' and right(a, 1) = 'c') then 'v' else 'c' end, '')"


def _measure(x: str) -> str:
    return f"len(regexp_extract_all({_shape(x)}, 'v+c+'))"


def _short(x: str) -> str:
    return f"((length({x}) >= 3 and right({_shape(x)}, 3) = 'cvc' and right({x}, 1) not in ('w', 'x', 'y')) or (length({x}) = 2 and {_shape(x)} = 'vc'))"


def _less(n: int, x: str = "w") -> str:
    return f"left({x}, greatest(length({x}) - {n}, 0))"


def _longest(table: list[tuple[str, str]], condition: str = "> 0") -> str:
    """The word with its longest ending of the table replaced, if what stands before it is long enough."""
    rows = []
    for end, new in sorted(table, key=lambda x: -len(x[0])):
        root = _less(len(end))
        counted = f"{root} || 'l'" if end == "logi" else root
        more = f" and right({root}, 1) in ('s', 't')" if end == "ion" else ""
        rows.append(f"when ends_with(w, '{end}') then case when {_measure(counted)} {condition}{more} then {root} || '{new}' else w end")
    return "case " + " ".join(rows) + " else w end"


def stem_table(words: str) -> str:
    """SQL for (word, stem) of the words in the query `words`, which has a column word."""
    has = lambda x: f"contains({_shape(x)}, 'v')"
    steps = [
        f"case when ends_with(w, 'ies') and length(w) = 4 then {_less(1)} when ends_with(w, 'sses') or ends_with(w, 'ies') then {_less(2)} when ends_with(w, 's') and not ends_with(w, 'ss') then {_less(1)} else w end",
        f"case when ends_with(w, 'ied') then case when length(w) = 4 then {_less(1)} else {_less(2)} end when ends_with(w, 'eed') then case when {_measure(_less(3))} > 0 then {_less(1)} else w end"
        f" when ends_with(w, 'ed') and {has(_less(2))} then '+' || {_less(2)} when ends_with(w, 'ing') and {has(_less(3))} then '+' || {_less(3)} else w end",
        "case when left(w, 1) <> '+' then w when right(w, 2) in ('at', 'bl', 'iz') then w[2:] || 'e'"
        f" when length(w) > 2 and right(w, 1) = right({_less(1)}, 1) and right({_shape('w[2:]')}, 1) = 'c' then case when right(w, 1) in ('l', 's', 'z') then w[2:] else {_less(1, 'w[2:]')} end"
        f" when {_measure('w[2:]')} = 1 and {_short('w[2:]')} then w[2:] || 'e' else w[2:] end",
        f"case when ends_with(w, 'y') and length(w) > 2 and right({_shape(_less(1))}, 1) = 'c' then {_less(1)} || 'i' else w end",
        f"case when ends_with(w, 'alli') and {_measure(_less(4))} > 0 then {_less(2)} else w end",
        _longest(STEP2), _longest(STEP3), _longest([(e, "") for e in STEP4], "> 1"),
        f"case when ends_with(w, 'e') and ({_measure(_less(1))} > 1 or ({_measure(_less(1))} = 1 and not {_short(_less(1))})) then {_less(1)} else w end",
        f"case when ends_with(w, 'll') and {_measure(_less(1))} > 1 then {_less(1)} else w end",
    ]
    sql = f"select word, word as w from ({words})"
    for step in steps:
        sql = f"select word, {step} as w from ({sql})"
    known = " ".join(f"when '{a}' then '{b}'" for a, b in IRREGULAR.items())
    return f"select word, case word {known} else case when length(word) <= 2 then word else w end end as stem from ({sql})"
