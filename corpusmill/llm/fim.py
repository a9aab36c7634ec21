"""Fill-in-middle by relations: units of texts as rows, running sums of their lengths, cut requests that meet them by ordinal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.base import free

#: A line with its end, or a last line without.
LINES = r"[^\n]*\n|[^\n]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def draws(id_col: Column, seed: int) -> list[Column]:
    """Four numbers of a document: groups of eight hexadecimal digits of the SHA-256 of seed:id; a null id counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def arranged(form: Column, text: Column, first: Column, second: Column) -> Column:
    """The output of a text whose prefix has `first` code points and whose middle ends after `second`."""
    prefix, middle = F.substr(text, F.lit(1), first), F.substr(text, first + 1, second - first)
    suffix = F.substr(text, second + 1)
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(text)


def restored(form: Column, output: Column) -> Column:
    """The text that an output was made of. As no text that is cut holds a marker, and a marker begins with the only '<' that it
    has, each marker's first occurrence is its own."""
    second = F.when(form == "psm", F.lit(SUFFIX)).otherwise(F.lit(PREFIX))
    rest = F.substr(output, F.lit(len(PREFIX) + 1))
    at = F.locate(SUFFIX, rest, 1)
    at = F.when(form == "psm", at).otherwise(F.locate(PREFIX, rest, 1))
    end = F.locate(MIDDLE, rest, 1)
    one = F.substr(rest, F.lit(1), at - 1)
    two = F.substr(rest, at + F.length(second), end - at - F.length(second))
    middle = F.substr(rest, end + len(MIDDLE))
    return F.when(form == "psm", F.concat(one, middle, two)).when(form == "spm", F.concat(two, middle, one)).otherwise(output)


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", units: str = LINES, seed: int = 7, rate: int = 100, spm: int = 50) -> DataFrame:
    """(id, text, n, form, prefix_chars, middle_chars, output) of each row: its text cut at two of its n units' ends and rearranged.

    Units are the matches of a pattern whose matches cover every text. They become rows (posexplode), a running sum over a
    document gives each unit's end, and a document's cut requests meet those ends by ordinal; the offsets are gathered for each
    document and cut its text by substring. Only lengths travel, a list for each document, and all of that runs where the lists
    have been dealt to; texts are shuffled once, to the offsets, and never sorted. Rows that share id and text share their cuts:
    they are combined before they are shuffled, so that a row that a third of the table repeats costs no task more than others.

    form: plain if the text is empty or holds a marker, or by the third draw for 100 - rate of a hundred documents; otherwise
    spm for `spm` of a hundred by the fourth, else psm. prefix_chars and middle_chars count code points and are null if plain.
    Null texts are empty; null ids draw as the empty id does; very long texts are cut as any other; repeated rows stay; other
    columns are ignored, whatever their names; an empty table gives an empty result.
    """
    h1, h2, h3, h4 = draws(F.col("id"), seed)
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    base = base.withColumns({"own": F.coalesce(F.col("id").cast("string"), F.lit("")), "content": F.xxhash64("text")})
    key = ["own", "content"]
    marked = F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE))
    form = F.when((F.col("text") == "") | marked | (h3 % 100 >= rate), "plain").when(h4 % 100 < spm, "spm").otherwise("psm")
    lengths = F.transform(F.regexp_extract_all("text", F.lit(units), F.lit(0)), F.length)
    # one struct, so that requests and units read one shuffle
    each = base.groupBy(*key).agg(F.first(F.struct(lengths.alias("lengths"), form.alias("form"), h1.alias("h1"), h2.alias("h2"))).alias("of"))
    n = F.size("of.lengths").cast("long")
    one, two = F.col("of.h1") % (n + 1), F.col("of.h2") % (n + 1)
    requests = each.select(*key, n.alias("n"), F.col("of.form").alias("form"), F.when(F.col("of.form") != "plain", F.array(F.least(one, two), F.greatest(one, two))).alias("cuts"))
    ends = each.select(*key, F.posexplode("of.lengths").alias("pos", "length")).withColumn("end", F.sum("length").over(Window.partitionBy(*key).orderBy("pos")))
    ends = ends.select(*(F.col(c).alias(f"{c}_") for c in key), (F.col("pos") + 1).cast("long").alias("ordinal"), "end")
    met = requests.hint("merge").join(ends, (F.col("own") == F.col("own_")) & (F.col("content") == F.col("content_")) & F.array_contains("cuts", F.col("ordinal")), "left")
    offsets = met.groupBy(*key, "n", "form").agg(*(F.coalesce(F.max(F.when(F.col("ordinal") == F.col("cuts")[k], F.col("end"))), F.lit(0)).cast("int").alias(x) for k, x in enumerate(("first", "second"))))
    cuts = base.join(offsets.hint("shuffle_hash"), key)
    plain = F.col("form") == "plain"
    return cuts.select(
        F.col("id").alias(id_col), F.col("text").alias(free(docs.select(id_col), "text")[0]), "n", "form", F.when(~plain, F.col("first").cast("long")).alias("prefix_chars"), F.when(~plain, (F.col("second") - F.col("first")).cast("long")).alias("middle_chars"),
        arranged(F.col("form"), F.col("text"), F.col("first"), F.col("second")).alias("output"),
    )
