"""Spelling, phonetic codes and edit measures as queries; their SQL is written apart from the library's."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkforge import config as C
from linkforge.functions import strings
from linkforge.operators import spelling

from .demo import World
from .registry import register, spark_sql


def pairs(w: World) -> DataFrame:
    return spark_sql(w, "select doc_id, address_id, upper(raw_address) as a, full_address as b from pairs")


_PAIR_SQL = "select doc_id, address_id, upper(raw_address) as a, full_address as b from pairs"
register(
    "m_jaro", lambda w: pairs(w).select("doc_id", "address_id", F.round(strings.jaro("a", "b"), 6).alias("similarity")),
    f"select doc_id, address_id, round(jaro_similarity(a, b), 6) as similarity from ({_PAIR_SQL}) p",
)
register("m_osa", lambda w: pairs(w).select("doc_id", "address_id", strings.osa("a", "b").alias("edits"), strings.osa("a", "b", 3).alias("within_three")))


def phonetic(w: World) -> DataFrame:
    words = w.gaz.select(F.explode(F.split("full_address", r"[\s,]+")).alias("word")).filter("word <> ''").distinct()
    return words.selectExpr("word", f"{strings.phonetic_a('word')} as code", "soundex(word) as sound")


def _phonetic_sql() -> str:
    """The code before its runs are collapsed."""
    x = "upper(trim(word))"
    # A pair's first letter can be the second of the pair before it: all pairs are found in one left-to-right pass.
    pieces = f"regexp_extract_all({x}, '{'|'.join(p for p, _ in C.PHONETIC_PAIRS)}|.')"
    table = " ".join(f"when '{p}' then '{to}'" for p, to in (*C.PHONETIC_PAIRS, *C.PHONETIC_LETTERS))
    vowel = "i = 1 and regexp_matches(p, '^[AEIOU]$')"
    code = f"array_to_string(list_transform({pieces}, lambda p, i: case p {table} else case when regexp_matches(p, '^[BDFHJKLMNPQRSTVWX]$') or ({vowel}) then p else '' end end), '')"
    cut = f"left({code}, 6)"
    return f"select word, {cut} as cut from words"


_RUNS = "array_to_string(list_filter(string_split(cut, ''), lambda c, k: k = 1 or c <> substring(cut, k - 1, 1)), '')"
register(
    "f_phonetic_a", lambda w: phonetic(w).select("word", "code"),
    f"with words as (select distinct unnest(string_split_regex(full_address, '[\\s,]+')) as word from gaz), coded as ({_phonetic_sql()}) select word, {_RUNS} as code from coded where word <> ''",
)
register("f_soundex", lambda w: phonetic(w).select("word", "sound"))
register(
    "f_phonetic_overlap",
    lambda w: pairs(w).selectExpr("doc_id", "address_id", f"{strings.phonetic_overlap('a', 'b')} as shared"),
)

_SKIPPED = ", ".join(f"'{t}'" for t in C.SPELLING_SKIPPED)
_SEEDS = " union all ".join(
    [f"select unnest([{', '.join(chr(39) + t + chr(39) for t in terms)}]) as term, {freq} as freq, {n} as source" for terms, freq, n in ((C.SPELLING_LOCALITIES, 10000, 2), (C.SPELLING_SUFFIXES, 50000, 3))]
)
_DICTIONARY_SQL = (
    "select term, arg_max(freq, source) as freq from ("
    "select upper(trim(list_last(string_split(full_address, ',')))) as term, count(*) as freq, 0 as source from gaz group by 1 union all "
    f"select term, count(*), 1 from (select unnest(regexp_extract_all(upper(full_address), '[A-Z]+')) as term from gaz) t where term not in ({_SKIPPED}) group by 1 union all {_SEEDS}) u where length(term) >= 3 group by term"
)


def dictionary(w: World) -> DataFrame:
    return w.stage("dictionary", lambda: spelling.build_dictionary(w.gaz, "full_address"))


def words(w: World) -> DataFrame:
    return w.docs.select(F.explode(F.split("raw_address", r"[\s,]+")).alias("word")).filter("word <> ''")


_LOOKUP_SQL = (
    f"with dict as materialized ({_DICTIONARY_SQL}), words as materialized (select distinct upper(word) as word from (select unnest(string_split_regex(raw_address, '[\\s,]+')) as word from docs) s where word <> ''), "
    "near as (select word, term, damerau_levenshtein(word, term) as distance, freq from words join dict on abs(length(word) - length(term)) <= 2 "
    "where word not in (select term from dict) and damerau_levenshtein(word, term) <= 2 union all select word, term, 0, freq from words join dict on word = term) "
    "select word, term, distance, freq, row_number() over (partition by word order by distance, freq desc, term) as rank from near"
)
register("f_spell_dictionary", dictionary, _DICTIONARY_SQL)
register("f_spell_statistics", lambda w: spelling.dictionary_statistics(dictionary(w)))
# The other engine's distance may edit a part twice; on these words it gives the same numbers.
register("f_spell_lookup", lambda w: spelling.lookup(words(w), dictionary(w)), _LOOKUP_SQL)
register("f_spell_correct", lambda w: spelling.correct(w.docs.select("doc_id", F.regexp_replace("can", ",", " ").alias("can")), dictionary(w), "doc_id", "can"))
register("f_spell_impact", lambda w: spelling.correction_impact(w.docs, dictionary(w), "can"))
