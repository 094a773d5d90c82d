"""Joins of parsed parts that keep the first addresses only, as SQL for Spark: the cut is made a key of the gazetteer, before documents meet it.

Rows are those of the plain joins in matching.py and engines.py, which cut a document's
addresses after all of them have met.
"""

from __future__ import annotations


def firsts(k: int, must: tuple[str, ...], wild: tuple[str, ...] = ()) -> str:
    """(address_id, m, must, wild): the k smallest addresses for each value of must and of each choice of wild.

    Bit n of m says that wild[n] is in the key; where it is not, the column is ''.
    """
    keyed = [*must, *[f"case when m & {1 << n} > 0 then {c} else '' end as {c}" for n, c in enumerate(wild)]]
    rows = f"select address_id, m, {', '.join(keyed)} from (select *, explode(sequence(0, {(1 << len(wild)) - 1})) as m from gaz_parts where {' and '.join(f'{c} <> {chr(39) * 2}' for c in must)}) x1"
    return f"select * from (select *, row_number() over (partition by m, {', '.join([*must, *wild])} order by address_id) as kn from ({rows}) x2) x3 where kn <= {k}"


def asked(a: str, wild: tuple[str, ...]) -> str:
    """m of a document: the parts that it has."""
    return "(" + " + ".join(f"case when {a}.{c} <> '' then {1 << n} else 0 end" for n, c in enumerate(wild)) + ")"


_PARTS = ("num", "city", "pc")
WHICHEVER = f"select a.doc_id, b.address_id from doc_parts a join ({firsts(50, ('way',), _PARTS)}) b on b.way = a.way and b.num = a.num and b.city = a.city and b.pc = a.pc and b.m = {asked('a', _PARTS)} where a.way <> ''"


def same_road(k: int) -> str:
    return f"select a.doc_id, b.address_id from doc_parts a join ({firsts(k, ('way', 'city'), ('num',))}) b on b.way = a.way and b.city = a.city and b.num = a.num and b.m = {asked('a', ('num',))} where a.way <> '' and a.city <> ''"


def like_road(k: int, least: float) -> str:
    """Cut for each different road and house of documents."""
    return (
        "select a.doc_id, l.address_id from doc_parts a join (select way, num, address_id from (select c.way, c.num, b.address_id, row_number() over (partition by c.way, c.num order by r.similarity desc, b.address_id) as rn "
        f"from (select distinct way, num from doc_parts where way <> '') c join like_roads r on r.way_a = c.way join ({firsts(k, ('way',), ('num',))}) b on b.way = r.way_b and b.num = c.num and b.m = {asked('c', ('num',))} "
        f"where r.similarity >= {least}) s where rn <= {k}) l on l.way = a.way and l.num = a.num"
    )


FUZZY_ROAD = (
    "select a.doc_id, l.address_id, round(l.similarity, 6) as similarity from doc_parts a join (select city, way, num, address_id, similarity from ("
    "select c.city, c.way, c.num, c.similarity, b.address_id, row_number() over (partition by c.city, c.way, c.num order by c.similarity desc, b.address_id) as rn from ("
    # From .8 on the house is not asked for.
    "select p.city, p.way, p.num, r.way_b, r.similarity, case when p.num = '' or r.similarity >= 0.8 then 0 else 1 end as m from (select distinct city, way, num from doc_parts where way <> '' and city <> '') p "
    "join like_roads r on r.way_a = p.way where r.similarity >= 0.7) c "
    f"join ({firsts(20, ('city', 'way'), ('num',))}) b on b.city = c.city and b.way = c.way_b and b.m = c.m and b.num = case when c.m = 1 then c.num else '' end) t where rn <= 20) l on l.city = a.city and l.way = a.way and l.num = a.num"
)

HIERARCHICAL = (
    "select doc_id, address_id, level, confidence from (select *, min(level) over (partition by doc_id) as first, row_number() over (partition by doc_id, level order by address_id) as rn from ("
    "select d.doc_id, g.address_id, 1 as level, 0.95 as confidence from docs d join (select * from (select address_id, can, row_number() over (partition by can order by address_id) as kn from gaz) f where kn <= 5) g on g.can = d.can "
    # Both start with the house's first word.
    "union all select d.doc_id, g.address_id, 2, 0.90 from docs d join gaz g on g.pc = d.pc and split_part(d.can, ' ', 1) = split_part(g.house, ' ', 1) and left(d.can, length(g.house) + 1) = concat(g.house, ' ') "
    f"union all select a.doc_id, b.address_id, 3, 0.80 from doc_parts a join ({firsts(5, ('way', 'city'))}) b on a.way = b.way and a.city = b.city where a.way <> '' and a.city <> '' "
    f"union all select a.doc_id, b.address_id, 4, 0.70 from doc_parts a join ({firsts(5, ('way',))}) b on a.way = b.way where a.way <> '') u) v where level = first and rn <= 5"
)

_BITS = {"pc": 1, "num": 2, "way": 4, "city": 8}
#: The sets of equal parts that make an address a candidate: the postcode, or road and town.
_SETS = [m for m in range(16) if m & 1 or m & 12 == 12]


def _keyed(key: str, table: str) -> str:
    """A row for each set whose parts it has, the other parts ''."""
    has = " and ".join(f"(m & {b} = 0 or {c} <> '')" for c, b in _BITS.items())
    return f"select {key}, m, total, {', '.join(f'case when m & {b} > 0 then {c} else {chr(39) * 2} end as k_{c}' for c, b in _BITS.items())} from (select *, " + (
        " + ".join(f"case when {c} <> '' then 1 else 0 end" for c in _BITS) + f" as total, explode(array({', '.join(map(str, _SETS))})) as m from {table}) x where {has}"
    )


#: No score falls by another equal part, so a set's smallest address scores at least as the set does, and the best of the sets is the best address.
COMPONENT_SEARCH = (
    "select doc_id, address_id, score from (select *, row_number() over (partition by doc_id order by score desc, address_id) as rn from (select doc_id, address_id, round(least(1.0, case when pc_same and num_same then 1.0 else matched / nullif(cast(total as double), 0) "
    "+ case when pc_same then 0.2 else 0.0 end + case when num_same and way_same then 0.1 else 0.0 end end), 6) as score from (select a.doc_id, b.address_id, a.total, bit_count(a.m) as matched, "
    + ", ".join(f"a.m & {b} > 0 as {c}_same" for c, b in _BITS.items())
    + f" from ({_keyed('doc_id', 'doc_parts')}) a join (select m, k_pc, k_num, k_way, k_city, min(address_id) as address_id from ({_keyed('address_id', 'gaz_parts')}) y group by m, k_pc, k_num, k_way, k_city) b "
    "on b.m = a.m and b.k_pc = a.k_pc and b.k_num = a.k_num and b.k_way = a.k_way and b.k_city = a.k_city) q) r) s where rn = 1"
)


def cascade(passes: list[str], under: list[int]) -> str:
    """engines.cascade() with one shuffle: a document's counts stand beside its rows."""
    every = " union all ".join(f"select doc_id, address_id, {n} as pass from ({p}) p{n}" for n, p in enumerate(passes))
    counts = ", ".join(f"sum(case when pass = {n} then 1 else 0 end) over (partition by doc_id) as c{n}" for n in range(len(passes)))
    taken, inner = "c0", f"select *, {counts} from ({every}) e"
    for n in range(1, len(passes)):
        inner = f"select *, {taken} < {under[n]} as go{n} from ({inner}) k{n}"
        taken = f"{taken} + case when go{n} then c{n} else 0 end"
    go = " or ".join(["pass = 0"] + [f"(pass = {n} and go{n})" for n in range(1, len(passes))])
    return f"select doc_id, address_id, min(pass) as pass from ({inner}) t where {go} group by doc_id, address_id"
