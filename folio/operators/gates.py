"""The gate: named checks of a page's Markdown against what is known of the page, its verdict, escalation and outcome.

A page row has md and the profile: kind (digital, scan or other), ocr, hidden_layer, chars, text_ok, script, ink, dpi, size_px, grade,
low, layer_words, layer_verdict, asked, read, and what the validators found on it: layout, ragged, blank_table, column_types,
running_balance, totals. Every profile column may be null and then says nothing. Null Markdown is empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from folio.functions.text import dominant_script, plain, script_counts

# The thresholds of the checks.
LAYER_CHARS, LAYER_WORDS, LOST, INK, SCAN_CHARS = 100, 15, 0.5, 0.01, 20
NOISE, NOISE_WORDS, POOR, LOW_DPI, LOW_PX, DEFAULT_DPI = 0.4, 30, 0.45, 150, 1000, (72, 96)
PER_INK, SIZE_LOW, SIZE_HIGH = 15_000.0, 0.25, 3.0
IMPLAUSIBLE, LEAST_WORDS = 0.25, 12
ODD_SHARE, NORMAL_SHARE = 0.01, 0.9
#: Checks that are only notes where the text layer came out intact, and checks that do not escalate a reading.
NOTES, MILD = ("table_shape", "totals", "running_balance", "docling_grade"), ("low_resolution", "docling_grade")
CHECKS = ("coverage", "script", "docling_grade", "table_shape", "low_resolution", "degenerate", "expected_size", "plausibility", "column_types", "residue_read", "running_balance", "totals")
#: Scripts of a profile that no text contradicts.
ANY_SCRIPT = ("Latin", "Mixed", "none", "")
ODD = r"[\x{FFFD}\x{E000}-\x{F8FF}\x{0000}-\x{0008}\x{000E}-\x{001F}]"


def bare(text: Column) -> Column:
    """The text without white space and format characters."""
    return F.regexp_replace(text, r"[\s\p{Cf}]+", "")


def reads_well(bare: Column) -> Column:
    """text_ok() of what bare() leaves: a column to be bound before, as it is read several times."""
    n = F.length(bare)
    odd, normal = (n - F.length(F.regexp_replace(bare, f"{chars}+", "")) for chars in (ODD, r"[\p{L}\p{N}\p{P}\p{S}\p{M}]"))
    return F.coalesce((n > 0) & (odd <= ODD_SHARE * n) & (normal >= NORMAL_SHARE * n), F.lit(False))


def text_ok(text: Column) -> Column:
    """Whether a text reads like one: hardly any replacement, private or control characters, mostly letters, digits, marks and signs.
    False for texts without characters."""
    return reads_well(bare(text))


def words(text: Column) -> Column:
    return F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")


def latin_words(text: Column) -> Column:
    """Latin words of three letters or more, in lower case."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda w: (F.length(w) >= 3) & w.rlike(r"^[0-9a-z\x{00C0}-\x{024F}]*[a-z\x{00C0}-\x{024F}][0-9a-z\x{00C0}-\x{024F}]*$"))


def single_letters(ws: Column) -> Column:
    """Share of words() of one character that is no digit, null under NOISE_WORDS words."""
    return F.when(F.size(ws) >= NOISE_WORDS, F.size(F.filter(ws, lambda w: (F.length(w) == 1) & ~w.rlike(r"^\p{Nd}$"))) / F.size(ws))


def implausible(ws: Column) -> Column:
    """Share of latin_words() that mix letters and digits, have four letters and no vowel, or five consonants in a row; null under
    LEAST_WORDS of them."""
    bad = F.filter(ws, lambda w: w.rlike("[0-9]") | (w.rlike(r"^[^aeiouy\x{00C0}-\x{024F}]{4,}$")) | w.rlike("[bcdfghjklmnpqrstvwxz]{5}"))
    return F.when(F.size(ws) >= LEAST_WORDS, F.size(bad) / F.size(ws))


def wanted_script() -> Column:
    """The script of the profile, null where it was read off bad text."""
    return F.when(F.col("text_ok") | F.col("text_ok").isNull(), F.col("script"))


def measured(pages: DataFrame) -> DataFrame:
    """The page rows with what the checks read off the text in place of md, each once and only on pages that a check asks it of."""
    c = F.col
    scan, by_ocr = c("kind") == "scan", c("ocr") & (c("kind") == "scan") | (c("kind") == "digital") & c("hidden_layer")
    rows = pages.withColumn("text", plain(F.coalesce("md", F.lit("")))).drop("md")
    rows = rows.withColumns({"n": F.length(F.regexp_replace("text", r"\s+", "")), "bare": bare(c("text")), "counts": F.when(~wanted_script().isin(*ANY_SCRIPT), script_counts(c("text"))), "ws": F.when(scan, words(c("text"))), "lw": F.when(by_ocr, latin_words(c("text")))})
    rows = rows.withColumns({"ok_text": reads_well(c("bare")), "got": F.when(c("counts").isNotNull(), dominant_script(c("counts"))), "singles": single_letters(c("ws")), "odd_words": implausible(c("lw"))})
    return rows.drop("text", "bare", "counts", "ws", "lw")


def check_pages(pages: DataFrame) -> DataFrame:
    """(doc, page, failed, notes, verdict, escalate, outcome): failed and notes are lists of names in the order of CHECKS."""
    return judged(measured(pages))


def judged(rows: DataFrame) -> DataFrame:
    """check_pages() of the rows of measured()."""
    c = F.col
    digital, scan = c("kind") == "digital", c("kind") == "scan"
    short = c("n") < 20
    by_layer = digital & (c("layer_words") >= LAYER_WORDS)
    lost = F.when(by_layer, c("layer_verdict") != "intact").when(digital, (c("chars") >= LAYER_CHARS) & (c("n") < LOST * c("chars"))).when(scan, (c("ink") >= INK) & (c("n") < SCAN_CHARS))
    got, want = c("got"), wanted_script()
    mismatch = ~want.isin(*ANY_SCRIPT) & (got != "") & (got != "Mixed") & (got != want)
    dpi = F.when(~(c("size_px").isNotNull() & F.round("dpi").isin(*DEFAULT_DPI)), c("dpi"))
    coarse = scan & F.when(dpi > 0, dpi < LOW_DPI).otherwise(F.array_max("size_px") < LOW_PX)
    read_by_ocr = c("ocr") & scan | digital & c("hidden_layer")
    expected = c("ink") * PER_INK
    bad = {
        "coverage": lost, "script": ~short & (~c("ok_text") | scan & (c("singles") > NOISE) | mismatch), "docling_grade": (F.lower("grade") == "poor") | (c("low") < POOR),
        "table_shape": c("ragged") | c("blank_table") | c("layout"), "low_resolution": coarse, "degenerate": ~digital & c("runaway"),
        "expected_size": c("ocr") & scan & (c("ink") >= INK) & ((c("n") < SIZE_LOW * expected) | (c("n") > SIZE_HIGH * expected)),
        "plausibility": read_by_ocr & (c("odd_words") > IMPLAUSIBLE), "column_types": read_by_ocr & c("column_types"), "residue_read": c("read") < c("asked"),
        "running_balance": c("running_balance"), "totals": c("totals"),
    }
    wanted = digital & (c("chars") >= LAYER_CHARS) | scan & (c("ink") >= INK)
    empty = (c("n") == 0) & ~F.coalesce(c("has_table"), F.lit(False)) & ~F.coalesce(wanted, F.lit(False))
    rows = rows.select("doc", "page", empty.alias("empty"), (digital & (c("layer_verdict") == "intact")).alias("intact"), (c("ocr") & scan).alias("by_ocr"), F.filter(F.array(*(F.when(F.coalesce(bad[k], F.lit(False)), k) for k in CHECKS)), lambda k: k.isNotNull()).alias("all"))
    note = F.coalesce("intact", F.lit(False))
    rows = rows.withColumn("failed", F.when(c("empty"), F.array().cast("array<string>")).when(note, F.filter("all", lambda k: ~k.isin(*NOTES))).otherwise(c("all")))
    rows = rows.withColumn("notes", F.when(note & ~c("empty"), F.filter("all", lambda k: k.isin(*NOTES))).otherwise(F.array().cast("array<string>")))
    verdict = F.when(c("empty"), "empty").when(F.size("failed") > 0, "suspect").otherwise("ok")
    escalate = F.coalesce(c("by_ocr"), F.lit(False)) & F.exists("failed", lambda k: ~k.isin(*MILD))
    outcome = F.when(c("empty"), "no_text").when(F.size("failed") > 0, "low").otherwise("pass")
    return rows.select("doc", "page", F.array_join("failed", ",").alias("failed"), F.array_join("notes", ",").alias("notes"), verdict.alias("verdict"), escalate.alias("escalate"), outcome.alias("outcome"))


def failure_class(kind: Column, script: Column, has_table: Column, chars: Column) -> Column:
    """Of a page for a gold set: how it is read, whether it has tables, and whether its script is none of Latin letters."""
    how = F.when(chars == 0, "empty").otherwise(kind)
    return F.concat_ws("-", how, F.when(has_table, "table"), F.when(~F.lower(script).isin("latin", ""), "script"))


def page_plan(pages: DataFrame) -> DataFrame:
    """(doc, page, mode, blank): digital or scan, and whether there is nothing on the page: hardly any ink or light and no characters."""
    dark = (F.coalesce("ink", F.lit(1.0)) < 0.0003) & (F.coalesce("light", F.lit(1.0)) < 0.0003)
    return pages.select("doc", "page", F.when(F.col("kind") == "digital", "digital").otherwise("scan").alias("mode"), (dark & (F.coalesce("chars", F.lit(0)) == 0)).alias("blank"))


def page_runs(pages: DataFrame, most: int = 20) -> DataFrame:
    """(doc, first_page, last_page): runs of consecutive pages, cut after `most`."""
    from pyspark.sql import Window

    w = Window.partitionBy("doc").orderBy("page")
    rows = pages.select("doc", "page").distinct().withColumn("island", F.col("page") - F.row_number().over(w))
    place = F.row_number().over(Window.partitionBy("doc", "island").orderBy("page")) - 1
    rows = rows.withColumn("part", F.floor(place / most))
    return rows.groupBy("doc", "island", "part").agg(F.min("page").alias("first_page"), F.max("page").alias("last_page")).select("doc", "first_page", "last_page")


def layer_reliability(pages: DataFrame, sample: int = 12, texty: float = 0.7, good: float = 0.9, least: int = 50) -> DataFrame:
    """(doc, pages, sampled, reliable) of (doc, page, ok, chars): every n/sample-th page is looked at, `sample` at most; of these a
    share must have text, and of those with text a share must read well."""
    from pyspark.sql import Window

    w = Window.partitionBy("doc")
    rows = pages.withColumn("total", F.count("*").over(w)).withColumn("place", F.row_number().over(w.orderBy("page")) - 1)
    step = F.greatest(F.lit(1), F.floor(F.col("total") / sample))
    picked = rows.filter((F.col("place") % step == 0) & (F.col("place") / step < sample))
    has = F.col("chars") >= least
    k = picked.groupBy("doc").agg(F.max("total").alias("pages"), F.count("*").alias("sampled"), F.count_if(has).alias("texty"), F.count_if(has & F.col("ok")).alias("good"))
    reliable = (F.col("texty") >= texty * F.col("sampled")) & (F.col("good") >= good * F.col("texty")) & (F.col("texty") > 0)
    return k.select("doc", "pages", "sampled", reliable.alias("reliable"))
