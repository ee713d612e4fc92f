"""Free-entered values mapped to the terms of a list (problem 3), by symmetric deletes.

Known spellings of the terms, with all strings that arise from them by up to MAX_EDITS deletions, form a dictionary of
fixed size. Every distinct entry is looked up in it, as it is and then with its own deletes; the pairs that meet are
verified by a weighted Damerau-Levenshtein distance and ranked by it, then by how often the term itself is entered.
Entries that meet none are reported as misses. Spellings are the terms, their initials and the abbreviations in their
gloss, by rule, and a table of other names, which is an input: default_names() is the list for this vocabulary.
"""

from __future__ import annotations

from itertools import combinations

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factspan.functions.marks import squeezed
from factspan.session import staged

FIELDS = ["cell_type", "cell_type_family", "electrolyte_family"]
#: Edits allowed where one of two spellings has at least LONG characters; one from SHORT characters on, else none.
MAX_EDITS, LONG, SHORT = 2, 5, 4
#: Copies of the mapping over which rows of one entry are spread where the join is not a broadcast.
SALTS = 16

# Other names of the terms, abbreviations and translations, as plain() writes them: the default table.
ALIASES = {
    "RDE": ["r d e", "rotating disc electrode", "rotating disk electrode", "rotating disk", "rotating disc", "scheibenelektrode rot", "rotierende scheibenelektrode", "electrode a disque tournant"],
    "three_electrode_flow": ["3 el flow", "three electrode flow", "3 electrode flow cell", "three electrode flow cell", "flow cell three electrodes", "3 electrode flow"],
    "single_cell_MEA": ["mea single cell", "1 cell mea", "single cell mea", "einzelzelle mea", "mea 1 cell", "mea einzelzelle"],
    "stack": ["stacks", "cell stack", "multi cell stack", "zellstapel", "stapel", "empilement"],
    "acid": ["acidic", "acidic medium", "low ph", "sauer", "acido", "acide", "h2so4 acid", "hclo4 acid", "acid medium", "saures medium"],
    "alkaline": ["basic", "alkali", "basique", "alkalisch", "koh alkaline", "naoh alkaline", "alkaline medium", "high ph", "alcalin", "alcalino", "basico", "basisch"],
    "neutral": ["near neutral", "ph 7", "phosphate buffer neutral", "neutral ph", "neutre", "neutro", "neutral medium", "neutral buffer"],
    "three-electrode half-cell": ["half cell 3 el", "3 electrode half cell", "three electrode halfcell", "dreielektroden halbzelle", "demi cellule a trois electrodes", "3 el half cell"],
    "rotating disk electrode cell": ["rde cell", "rde set up", "rde setup", "rde", "rotating disc electrode", "rotating disk electrode", "rotierende scheibenelektrode", "rotating disc electrode cell"],
    "rotating ring-disk electrode cell": ["rrde", "rrde cell", "rotating ring disc", "rotating ring disk", "ring disc electrode", "ring disk electrode", "rrde set up"],
    "single-cell PEM electrolyser": ["pemwe single cell", "pem electrolyzer single cell", "pem electrolyser single cell", "pem water electrolyzer one cell", "pem elektrolyseur einzelzelle", "pemwe", "single cell pemwe", "pem single cell"],
    "anion-exchange membrane electrolyser": ["aemwe", "anion exchange electrolyser", "anion exchange electrolyzer", "aem electrolyzer", "aem electrolyser", "aem water electrolysis cell", "anion exchange membrane electrolyzer", "aem elektrolyseur"],
    "membrane electrode assembly test cell": ["mea test rig", "mea test cell", "mea fixture", "mea hardware", "mea cell"],
    "H-type cell": ["h cell", "h zelle", "cellule en h", "two compartment h cell", "celda en h", "2 compartment h cell"],
    "gas-diffusion electrode half-cell": ["gde cell", "gde half cell", "half cell w gde", "half cell with gde", "gas diffusion half cell", "gas diffusion electrode cell", "gde halbzelle"],
    "microfluidic flow cell": ["micro flow cell", "u flow cell", "microfluidic channel cell", "microfluidics cell", "microfluidic cell", "micro fluidic flow cell"],
    "scanning flow cell": ["sfc", "scanning cell flow", "scanning flow cell sfc", "sfc cell"],
    "channel flow electrode cell": ["cfe", "channel flow electrode", "channel electrode flow cell", "channel flow cell", "cfe cell"],
    "beaker cell": ["glass beaker set up", "open beaker", "undivided beaker", "becherglaszelle", "beaker", "glass beaker", "becherglas", "beaker set up"],
    "jacketed glass cell": ["water jacketed cell", "thermostatted jacketed cell", "double wall glass cell", "jacketed cell", "double walled glass cell", "doppelwandige glaszelle"],
    "zero-gap alkaline cell": ["zero gap awe", "alkaline zero gap", "zero gap alkaline electrolyser", "zero gap alkaline electrolyzer", "awe zero gap", "zero gap cell"],
    "short stack": ["kurzstack", "short stack 3 cells", "short stack 4 cells", "5 cell short stack", "3 cell short stack", "short stack of 5 cells"],
    "spectro-electrochemical cell": ["sec cell", "spectro ec cell", "spectroelectrochemistry cell", "spectroelectrochemical cell", "sec", "spektroelektrochemische zelle"],
    "electrochemical mass spectrometry cell": ["dems", "dems cell", "online ec ms cell", "ec ms cell", "ecms cell", "ec ms"],
    "quartz crystal microbalance cell": ["eqcm", "qcm cell", "quartz microbalance cell", "eqcm cell", "qcm", "quartz crystal microbalance"],
    "high-pressure autoclave cell": ["autoclave", "autoklav", "pressurised cell autoclave", "autoclave cell", "high pressure cell", "pressurized cell autoclave"],
    "bipolar electrode cell": ["bpe cell", "bipolar cell", "bipolar electrode set up", "bipolar electrode", "bpe"],
}
# Entries that say there is none of the listed terms, so that no edit turns them into one.
NO_TERM = [
    "n a", "na", "n s", "tbd", "other", "unknown", "custom", "mixed", "mixed setups", "as before", "see si", "not stated",
    "none", "not given", "redox battery", "photoelectrode", "battery tester", "coin cell", "pouch cell", "tube furnace",
    "glove box", "photo reactor", "solar simulator", "ionic liquid", "organic carbonate", "solid oxide", "molten salt",
]
_DECOR = r"^(?:lab|custom|home ?[- ]?(?:built|made)|in-house|\d+ ?cm ?[2²^]+) +(?=\S)|\[[^\]]*\]|\( ?home[- ]made ?\)|#\s*\d+|, ?-?\d+ ?°?c$"


def plain(c: Column) -> Column:
    """Lower case, without accents, decoration (home-made, 25 cm2, #2, [SI], ', 60 C') or punctuation; single blanks."""
    c = F.translate(squeezed(c), "_áàâäãéèêëíìîïóòôöõúùûüñçµμ", " aaaaaeeeeiiiiooooouuuuncuu")
    c = F.regexp_replace(F.trim(F.regexp_replace(c, r"^[\s;*.,]+|[\s;*.,]+$", "")), _DECOR, " ")
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(c), _DECOR, " "), r"[^\p{L}\p{N}]+", " "))


def edits_allowed(n: int) -> int:
    return MAX_EDITS if n >= LONG - 1 else 0


def deletes(word: str, edits: int) -> set[str]:
    """The word and all strings that arise from it by up to so many deletions."""
    out = {word}
    for k in range(1, edits + 1):
        for at in combinations(range(len(word)), k):
            out.add("".join(c for i, c in enumerate(word) if i not in at))
    return out


def distance(a: str, b: str) -> float:
    """Weighted Damerau-Levenshtein distance: swap of neighbours 0.8, doubled letter 0.8, other edits 1.

    A replaced first letter costs 0.2 more, so that among equals the form with the same beginning wins. What both have
    in common at their ends is skipped.
    """
    start, n, m = 0, len(a), len(b)
    while start < min(n, m) and a[start] == b[start]:
        start += 1
    while n > start and m > start and a[n - 1] == b[m - 1]:
        n, m = n - 1, m - 1
    gone = [0.8 if i and a[i] == a[i - 1] else 1.0 for i in range(n)]
    come = [0.8 if j and b[j] == b[j - 1] else 1.0 for j in range(m)]
    rows = [[0.0]]
    for j in range(start, m):
        rows[0].append(rows[0][-1] + come[j])
    for i in range(start, n):
        at, row = i - start, [rows[-1][0] + gone[i]]
        for j in range(start, m):
            k = j - start
            best = min(rows[at][k + 1] + gone[i], row[k] + come[j], rows[at][k] + (0.0 if a[i] == b[j] else 1.0 if i or j else 1.2))
            # swapped neighbours, also with one letter lost or added between them
            if at and k and a[i] == b[j - 1] and a[i - 1] == b[j]:
                best = min(best, rows[at - 1][k - 1] + 0.8)
            if at and k > 1 and a[i] == b[j - 2] and a[i - 1] == b[j]:
                best = min(best, rows[at - 1][k - 2] + 0.8 + come[j - 1])
            if at > 1 and k and a[i] == b[j - 1] and a[i - 2] == b[j]:
                best = min(best, rows[at - 2][k - 1] + 0.8 + gone[i - 1])
            row.append(best)
        rows.append(row)
    return rows[-1][-1]


@F.pandas_udf(T.DoubleType())
def _distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([distance(x, y) for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(T.ArrayType(T.LongType()))
def _deletes(field: pd.Series, word: pd.Series) -> pd.Series:
    """Hashes of field and delete; a chance collision only makes one more pair to verify."""
    mark = xxhash.xxh64_intdigest
    return pd.Series([[mark(f"{f}|{x}") >> 1 for x in deletes(w, edits_allowed(len(w)))] for f, w in zip(field, word)])


def _with_deletes(df: DataFrame) -> DataFrame:
    return df.withColumn("del", F.explode(_deletes("field", "plain")))


def default_names(spark: SparkSession) -> DataFrame:
    """term, name: other names of the terms of this vocabulary; term is null for entries that stand for none."""
    rows = [(t, a) for t, names in ALIASES.items() for a in names] + [(None, a) for a in NO_TERM]
    return spark.createDataFrame(rows, "term string, name string")


def names_by_rule(vocab_terms: DataFrame) -> DataFrame:
    """field, term_id, plain: initials of a term's words before its last (rotating disk electrode cell: rde, rde cell),
    and words of its gloss in capitals (DEMS), alone and with the term's last word."""
    words = F.split(plain(F.col("term")), " ")
    d = vocab_terms.select("field", "term_id", words.alias("w"), F.size(words).alias("n"), "gloss")
    last = F.element_at("w", -1)
    initials = F.array_join(F.transform(F.slice("w", F.lit(1), F.greatest(F.col("n") - 1, F.lit(1))), lambda x: F.substring(x, 1, 1)), "")
    initials = F.when((F.col("n") >= 4) & (F.length(initials) >= 3), F.array(initials)).otherwise(F.array().cast("array<string>"))
    said = F.transform(F.regexp_extract_all(F.coalesce("gloss", F.lit("")), F.lit(r"\b([A-Z]{3,})\b"), F.lit(1)), F.lower)
    short = F.array_distinct(F.concat(initials, said))
    both = F.concat(short, F.transform(short, lambda x: F.concat_ws(" ", x, last)))
    return d.select("field", "term_id", F.explode(both).alias("plain"))


def known_spellings(vocab_terms: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """field, term_id, plain: the terms and their other names; term_id 0 for entries that stand for none.

    A spelling given by the table of names goes before one made by rule; one that two terms share then goes to the
    greater id.
    """
    names = default_names(vocab_terms.sparkSession) if names is None else names
    own = vocab_terms.select("field", "term_id", "term")
    given = own.join(names.where("term is not null"), "term").select("field", "term_id", F.col("name").alias("plain"), F.lit(2).alias("rank"))
    none = names.where("term is null").withColumn("field", F.explode(F.array(*map(F.lit, FIELDS)))).select("field", F.lit(0).alias("term_id"), F.col("name").alias("plain"), F.lit(2).alias("rank"))
    terms = own.select("field", "term_id", plain(F.col("term")).alias("plain"), F.lit(3).alias("rank"))
    ruled = names_by_rule(vocab_terms).withColumn("rank", F.lit(1))
    whole = terms.unionByName(given).unionByName(none).unionByName(ruled)
    return whole.groupBy("field", "plain").agg(F.max_by("term_id", F.struct("rank", "term_id")).alias("term_id"))


def entries(facts: DataFrame) -> DataFrame:
    """fact_id, field, entry: the non-blank entries of the three fields."""
    f = F.explode(F.array(*(F.struct(F.lit(x).alias("field"), F.col(f"condition.{x}").alias("entry")) for x in FIELDS)))
    return facts.select("fact_id", f.alias("e")).select("fact_id", "e.*").where(F.length(squeezed(F.col("entry"))) > 0)


def term_mapping(entered: DataFrame, vocab_terms: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """field, entry, n, plain, term_id, cost: each distinct entry that is no term as it stands; term_id 0 for misses.

    entered: field and entry, repeated at will; names: other names of the terms (term, name), default_names() if None.
    Entries are counted first and staged, so that the work below grows with the vocabulary people use, not with the
    rows. An entry that is a known spelling needs no deletes; of the others all deletes are looked up. Ties of the
    weighted distance go to the term entered most often as it stands, then to the smaller id. Null and blank entries
    have no row.
    """
    spark = entered.sparkSession
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = staged(entered.groupBy("field", "entry").agg(F.count("*").alias("n")))
    terms = vocab_terms.select("field", F.col("term").alias("entry"), "term_id")
    often = terms.join(counts, ["field", "entry"], "left").select("field", "term_id", F.coalesce("n", F.lit(0)).alias("often"))
    ours = counts.join(F.broadcast(terms), ["field", "entry"], "left_anti").withColumn("plain", plain(F.col("entry")))  # terms: 27 rows
    words = ours.where("plain <> ''").select("field", "plain").distinct()
    known = staged(known_spellings(vocab_terms, names))
    exact = words.join(known, ["field", "plain"]).select("field", "plain", "term_id", F.lit(0.0).alias("cost"))
    # An entry longer than every known spelling by more than the allowed edits is a miss for certain.
    longest = known.groupBy("field").agg(F.max(F.length("plain")).alias("longest"))
    rest = words.join(known, ["field", "plain"], "left_anti").join(F.broadcast(longest), "field")  # three rows
    rest = rest.where(F.length("plain") <= F.col("longest") + MAX_EDITS).select("field", "plain").repartition(spread)
    table = _with_deletes(known.select("field", "plain")).withColumnRenamed("plain", "spelling")
    # The dictionary comes from the term list and its names alone: some 30,000 strings however much data there is.
    met = _with_deletes(rest).join(F.broadcast(table), ["field", "del"]).select("field", "plain", "spelling").distinct()
    near = met.repartition(spread).withColumn("cost", _distance("plain", "spelling"))
    limit = F.when(F.greatest(F.length("plain"), F.length("spelling")) >= LONG, MAX_EDITS + 0.2).otherwise(1.2)
    near = near.where(F.col("cost") <= limit).join(known.withColumnRenamed("plain", "spelling"), ["field", "spelling"])
    near = near.join(often, ["field", "term_id"], "left").groupBy("field", "plain").agg(
        F.min_by(F.struct("term_id", "cost"), F.struct("cost", -F.coalesce("often", F.lit(0)), "term_id")).alias("b")
    )
    best = exact.unionByName(near.select("field", "plain", "b.*"))
    return ours.join(best, ["field", "plain"], "left").select("field", "entry", "n", "plain", F.coalesce("term_id", F.lit(0)).alias("term_id"), "cost")


def found(facts: DataFrame, vocab_terms: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """p3_found: fact_id, field, term_id of each entry that is not written like a term; 0 where it stands for none.

    The mapping of distinct entries is joined back. A frequent entry may hold a third of all rows: rows are salted and
    the mapping, which is small against them, is repeated for each salt.
    """
    e = entries(facts)
    mapping = term_mapping(e, vocab_terms, names).select("field", "entry", "term_id")
    mapping = mapping.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = e.withColumn("salt", F.pmod(F.xxhash64("fact_id"), F.lit(SALTS)).cast("int"))
    return salted.join(mapping, ["field", "entry", "salt"]).select("fact_id", "field", F.col("term_id").cast("long").alias("term_id"))


def misses(facts: DataFrame, vocab_terms: DataFrame) -> DataFrame:
    """field, entry, n: entries that stand for no term, with how often each was made."""
    return term_mapping(entries(facts), vocab_terms).where("term_id = 0").select("field", "entry", "n")
