"""Document fingerprints by Order MinHash, with DataFrame functions only.

The k-mers of a text are its runs of ``K`` words (a text with fewer words is one k-mer), numbered by
occurrence so that repeats count. Each numbered k-mer has a hash; the upper bits deal it to one of
``TUPLES * LENGTH`` cells, and each cell selects its minimal k-mer. The ``LENGTH`` selected k-mers of a
tuple are put in the order in which they stand in the text and hashed; the fingerprint holds these
``TUPLES`` hashes. Dealing to cells stands for independent orders of all k-mers: one hash of each
k-mer instead of one for each order. A cell without k-mers takes over the next cell's. The likeness of
two fingerprints is the share of equal hashes; it falls with the k-mers that differ and with those
that changed places, as the edit distance does.

Every step is an array expression over one row. Steps that the next one uses several times are fixed
by a one-row generator, so that the optimizer doesn't evaluate them again inside a lambda.

Defined results: a null text counts as empty; an empty text has one k-mer, the empty word; equal texts
have equal fingerprints; other columns are ignored. For neighbours, rows are ordered by descending id
(null last), then by text; a table of one row has itself as neighbour; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K, TUPLES, LENGTH = 3, 32, 2
CELLS = TUPLES * LENGTH
#: Bits of a cell's number, and bits that hold a k-mer's place in the text.
CELL_BITS, PLACE_BITS = CELLS.bit_length() - 1, 31
PLACE = (1 << PLACE_BITS) - 1
WORD_BREAK = r"[ \t-\r]+"
HEX = 8


def fixed(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that is evaluated once for each row."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def with_fingerprint(df: DataFrame, text: Column, name: str) -> DataFrame:
    """``df`` with the fingerprint of ``text`` (not null) as a column of hex digits."""
    columns = df.columns
    df = fixed(df, "__w", F.transform(F.split(text, WORD_BREAK), lambda w: F.xxhash64(w)))
    last = F.greatest(F.lit(0), F.size("__w") - K)
    # get() is null past the end, and a null leaves a hash as it is
    kmer = lambda i: F.xxhash64(*[F.get("__w", i + j) for j in range(K)])
    packed = lambda i: F.shiftleft(F.shiftrightunsigned(kmer(i), 32), PLACE_BITS).bitwiseOR(i.cast("long"))
    df = fixed(df, "__s", F.sort_array(F.transform(F.sequence(F.lit(0), last), packed)))
    hash_of = lambda x: F.shiftright(x, PLACE_BITS)
    # sorted by k-mer and place: an element whose upper bits are those of the one before repeats a k-mer
    new = lambda array: lambda x, i: F.coalesce(x.bitwiseXOR(F.get(array, i - 1)) > PLACE, F.lit(True))
    df = fixed(df, "__u", F.filter("__s", new("__s")))
    nothing = F.array().cast("array<bigint>")
    df = fixed(
        df, "__d", F.when(F.size("__u") == F.size("__s"), nothing).otherwise(F.filter("__s", lambda x, i: ~new("__s")(x, i)))
    )
    # where each run of repeats starts; from it and the next start the occurrences of the run, counted from 1
    every = F.when(F.size("__d") > 0, F.sequence(F.lit(0), F.size("__d") - 1)).otherwise(F.array().cast("array<int>"))
    df = fixed(df, "__r", F.filter(every, lambda i: new("__d")(F.get("__d", i), i)))
    seen = F.flatten(
        F.transform("__r", lambda at, i: F.sequence(F.lit(1), F.coalesce(F.get("__r", i + 1), F.size("__d")) - at))
    )
    numbered = lambda x, o: F.shiftleft(F.shiftrightunsigned(F.xxhash64(hash_of(x), o), 32), PLACE_BITS).bitwiseOR(
        x.bitwiseAND(F.lit(PLACE))
    )
    once = F.transform("__u", lambda x: numbered(x, F.lit(0)))
    again = F.when(F.size("__d") > 0, F.zip_with("__d", seen, numbered)).otherwise(nothing)
    df = fixed(df, "__n", F.sort_array(F.concat(once, again)))
    cell_of = lambda x: F.shiftright(x, PLACE_BITS + 32 - CELL_BITS).cast("int")
    low_bits = (1 << (PLACE_BITS + 32 - CELL_BITS)) - 1
    least = F.filter("__n", lambda x, i: F.coalesce(x.bitwiseXOR(F.get("__n", i - 1)) > low_bits, F.lit(True)))
    df = fixed(df, "__c", least)
    # an empty cell takes over the next filled one's, the cells after the last one the first one's
    reach = lambda x, i: cell_of(x) - F.coalesce(cell_of(F.get("__c", i - 1)), F.lit(-1))
    filled = F.flatten(F.transform("__c", lambda x, i: F.array_repeat(x, reach(x, i))))
    beyond = F.array_repeat(F.get("__c", F.lit(0)), F.lit(CELLS - 1) - cell_of(F.element_at("__c", -1)))
    df = fixed(df, "__f", F.when(F.size("__c") == CELLS, F.col("__c")).otherwise(F.concat(filled, beyond)))

    def tuple_hash(t: Column) -> Column:
        chosen = [F.get("__f", t * LENGTH + j) for j in range(LENGTH)]
        a, b = chosen
        in_order = a.bitwiseAND(F.lit(PLACE)) <= b.bitwiseAND(F.lit(PLACE))
        first, second = F.when(in_order, a).otherwise(b), F.when(in_order, b).otherwise(a)
        return F.lpad(F.hex(F.shiftrightunsigned(F.xxhash64(t, hash_of(first), hash_of(second)), 64 - 4 * HEX)), HEX, "0")

    digits = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(TUPLES - 1)), tuple_hash), "")
    return df.select(*columns, digits.alias(name))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal tuple hashes of two fingerprints."""
    same = F.filter(
        F.sequence(F.lit(0), F.lit(TUPLES - 1)),
        lambda i: F.substr(a, i * HEX + 1, F.lit(HEX)) == F.substr(b, i * HEX + 1, F.lit(HEX)),
    )
    return F.size(same) / F.lit(float(TUPLES))


def with_next(
    df: DataFrame, id_col: str, prepare: Callable[[DataFrame], DataFrame], carried: dict[str, str], order: list[str]
) -> DataFrame:
    """``prepare(df)`` with columns of the next row by descending id; the last row's next one is the first.

    Rows are dealt to ranges of ids of about equal numbers, each followed by a copy of the first row
    of the next range. ``carried`` names the columns of the next row; ``order`` breaks ties of ids.
    ``prepare`` sees every row once (and those copies), before the rows are dealt.
    """
    spark = df.sparkSession
    wanted = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / wanted for i in range(1, wanted)]
    cuts = sorted(set(df.agg(F.percentile_approx(id_col, shares, 20 * wanted)).first()[0] or []))
    # ranges are numbered by descending id; nulls come last
    part = F.when(F.col(id_col).isNull(), len(cuts) + 1).otherwise(_place(F.col(id_col), cuts))
    dealt = df.withColumn("__part", part.cast("int"))
    firsts = dealt.groupBy("__part").agg(F.max(id_col).alias("first")).orderBy("__part").collect()  # one for each range
    follows = [(firsts[(i + 1) % len(firsts)]["first"], r["__part"]) for i, r in enumerate(firsts)]
    heads = spark.createDataFrame(follows, f"__first {df.schema[id_col].dataType.simpleString()}, __before int")
    ghosts = df.join(F.broadcast(heads), F.col(id_col).eqNullSafe(F.col("__first"))).select(
        *df.columns, F.col("__before").alias("__part"), F.lit(1).alias("__ghost")
    )
    both = prepare(dealt.withColumn("__ghost", F.lit(0)).unionByName(ghosts))
    at = Window.partitionBy("__part").orderBy("__ghost", F.col(id_col).desc_nulls_last(), *order)
    return (
        both.select("*", *[F.lead(c).over(at).alias(n) for n, c in carried.items()])
        .where("__ghost = 0")
        .drop("__ghost", "__part")
    )


def _place(value: Column, cuts: list[int]) -> Column:
    """How many of the sorted cuts are at or above the value, by halving."""
    if not cuts:
        return F.lit(0)
    middle = len(cuts) // 2
    return F.when(value > cuts[middle], _place(value, cuts[middle + 1 :])).otherwise(
        F.lit(len(cuts) - middle) + _place(value, cuts[:middle])
    )


def edited(text: Column, n_chars: Column, following: Column) -> Column:
    """The text with its last third replaced by the start of the following one."""
    third = F.floor(n_chars / 3).cast("int")
    return F.concat(F.substr(text, F.lit(1), n_chars.cast("int") - third), F.substr(following, F.lit(1), third))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint of every text and of its edited form, and their likenesses; see the module."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    printed = lambda df: with_fingerprint(df, F.col("text"), "fingerprint")
    paired = with_next(rows, "id", printed, {"next_text": "text", "next_print": "fingerprint"}, ["text"])
    paired = paired.withColumn("n_chars", F.char_length("text").cast("long"))
    paired = fixed(paired, "edit", edited(F.col("text"), F.col("n_chars"), F.col("next_text"))).drop("text", "next_text")
    paired = paired.withColumn("edited_sha256", F.sha2("edit", 256))
    done = with_fingerprint(paired, F.col("edit"), "edited_fingerprint")
    return done.select(
        F.col("id").alias(id_col), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_print")).alias("near_next"),
    )
