"""Text functions: Column in, Column out, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOOK_AROUND = "(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])"


def camel_words(x: Column, lower: bool = False) -> Column:
    """Parts of a camel-case identifier."""
    return F.split(x, LOOK_AROUND) if not lower else F.transform(F.split(x, LOOK_AROUND), F.lower)


def camel_spaced(x: Column) -> Column:
    return F.regexp_replace(x, LOOK_AROUND, " ")


def identifier_terms(x: Column, none: str = "NO_API_SEQUENCE") -> Column:
    """Lower-case terms of a dotted, underscored, camel-case name; the sentinel has none."""
    words = F.filter(F.split(F.lower(camel_spaced(F.translate(x, "._", "  "))), " +"), lambda w: w != "")
    return F.when(x == none, F.array().cast("array<string>")).otherwise(words)


def heading_level(x: Column) -> Column:
    """Number of leading `#`; 1000 when there is none."""
    n = F.length(F.regexp_extract(F.trim(x), "^(#*)", 1))
    return F.when(n == 0, F.lit(1000)).otherwise(n)


def heading_title(x: Column) -> Column:
    n = F.length(F.regexp_extract(F.trim(x), "^(#*)", 1))
    return F.trim(F.substr(x, n + 1))


def first_line_title(x: Column) -> Column:
    """Title of the first heading line; empty when the text does not start with `#`."""
    t = F.trim(x)
    return F.when(t.startswith("#"), F.trim(F.split_part(F.regexp_replace(t, "^#+", ""), F.lit("\n"), F.lit(1)))).otherwise("")


def strip_tags(x: Column) -> Column:
    return F.regexp_replace(x, "<.*?>", "")


def strip_question_tags(x: Column) -> Column:
    x = F.regexp_replace(x, r"Q\d+\.\d+", " ")
    return F.regexp_replace(F.regexp_replace(x, r"Problem \d+\.\d+", " "), r"\d+\.\d+", " ")


def strip_urls(x: Column) -> Column:
    return F.regexp_replace(x, r"http\S+", " ")


def links_to_text(x: Column) -> Column:
    """Markdown links replaced by what they show."""
    return F.regexp_replace(x, r"\[([^]]+)\]\(\s*(http[s]?://[^)]+)\s*\)", "$1")


def strip_images(x: Column) -> Column:
    return F.regexp_replace(x, "(?is)<img.*?>", "")


def clean_markdown(x: Column) -> Column:
    """Drop marks, non-breaking spaces, links, URLs and images; one space between words."""
    x = F.regexp_replace(x, "[#`*]", "")
    x = F.replace(F.btrim(x, F.lit("!")), F.lit("&nbsp;"), F.lit(""))
    x = strip_images(strip_urls(links_to_text(x)))
    return F.trim(F.regexp_replace(x, r"[ \t\n\r\f]+", " "))


def code_fragments(x: Column) -> Column:
    """Trimmed texts between backticks, without empty ones."""
    return F.filter(F.transform(F.regexp_extract_all(x, F.lit("`([^`]*)`"), 1), lambda c: F.trim(c)), lambda c: c != "")


def has_letter_and_digit(x: Column) -> Column:
    return x.rlike("[A-Za-z]") & x.rlike("[0-9]")


def drop_step_numbers(x: Column) -> Column:
    """Words that are numbers with what surrounds them go."""
    return F.array_join(F.transform(F.split(x, r"\s+"), lambda w: F.regexp_replace(w, r"^\D*\d+\D*(\.)?\D*$", "")), " ")


def clean_step(x: Column) -> Column:
    """A step's normal form: no punctuation, tags, numbers or mixed words; camel case split; lower case."""
    x = F.regexp_replace(strip_tags(x), r"""[!"#$%&'()*+,\-/:;<=>?@\[\\\]^_`{|}~]""", " ")
    words = F.split(F.replace(drop_step_numbers(x), F.lit("."), F.lit(" ")), r"\s+")
    words = F.filter(words, lambda w: (w != "") & ~w.rlike("^[0-9]+$") & ~has_letter_and_digit(w))
    return F.lower(camel_spaced(F.array_join(words, " ")))


#: Terms that step labels lose, in order, and at which ends.
STEP_AFFIXES = [("lab", "both"), ("points", "both"), ("point", "both"), ("problem", "start"), ("question", "start"), ("part", "start"), ("solution", "end"), ("solutions", "end")]


def strip_affixes(x: Column, affixes: list[tuple[str, str]] = STEP_AFFIXES) -> Column:
    """A step label without the terms, each taken off once at its ends if a space parts it from the rest."""
    for term, side in affixes:
        if side != "end":
            x = F.regexp_replace(x, f"^{term} ", "")
        if side != "start":
            x = F.regexp_replace(x, rf" {term}\z", "")
    return x


#: Characters of a query that become spaces, and words that it loses at its start, in order.
QUERY_MARKS = [".", "!", "=", "–", '"', "\\", "$", "|", "'", ":", ")", "(", "[", "]", "}", "{"]
QUERY_HEADS = ["COGS", "Exercise", "Aside", "Week", "Assignment", "Assignments", "Sheet"]


def clean_query(x: Column) -> Column:
    """A heading as a search query: its title without points, marks, tags, numbers and course words, in lower case; empty if it is no heading."""
    x = clean_markdown(first_line_title(F.regexp_replace(strip_tags(x), r"\(\d+ points\)", "")))
    x = F.trim(F.translate(F.replace(drop_step_numbers(x), F.lit("(TODO)"), F.lit(" ")), "\"'", "  "))
    x = F.translate(F.replace(x, F.lit("(1.0 point)"), F.lit(" ")), "-", " ")
    x = F.trim(F.translate(strip_question_tags(x), "".join(QUERY_MARKS), " " * len(QUERY_MARKS)))
    for head in QUERY_HEADS:
        x = F.trim(F.regexp_replace(x, f"^{head} ", ""))
    return F.lower(F.trim(F.regexp_replace(x, r"\s+", " ")))


#: Words that topic names lose.
TOPIC_SKIPPED = [
    "lab", "labs", "checkpoint", "exercise", "exercises", "solution", "solutions", "question", "questions", "assignment", "assignments", "week", "weeks",
    "project", "problem", "problems",
]


def topic_name(x: Column) -> Column:
    """A topic's name in lower-case words, camel case split, without course words; topics of equal names are one."""
    words = F.split(F.lower(camel_spaced(F.translate(x, "_-", "  "))), r"\s+")
    return F.array_join(F.filter(words, lambda w: (w != "") & ~w.isin(TOPIC_SKIPPED)), " ")


def intent_of_question(x: Column) -> Column:
    """After the last `Question` and the last `:`, before the first `(`."""
    last = lambda v, s: F.element_at(F.split(v, s), -1)
    return F.trim(F.split_part(last(last(x, "Question"), ":"), F.lit("("), F.lit(1)))


def html_residue(x: Column) -> Column:
    """First line without heading marks or list tags."""
    return F.trim(F.translate(F.split_part(F.regexp_replace(x, "<dl.*?>", ""), F.lit("\n"), F.lit(1)), "#¶", ""))


def predicate_of(label: Column) -> Column:
    return F.translate(F.translate(F.lower(F.trim(label)), "()", ""), " ", "_")


def tokens(x: Column, pattern: str = "[a-z]+") -> Column:
    return F.regexp_extract_all(F.lower(x), F.lit(pattern), F.lit(0))


def print_to_call(code: Column) -> Column:
    """Print statements of the old syntax as calls."""
    return F.regexp_replace(code, r"(?m)^([ \t]*)print[ \t]+([^\n]+?)[ \t]*$", "$1print($2)")


def drop_magics(code: Column, use_pass: bool = False) -> Column:
    """Lines that start with `!` or `%` go, or become `pass` at their indent."""
    lines = F.split(code, "\n")
    magic = lambda x: F.trim(x).rlike("^[!%]")
    if use_pass:
        return F.array_join(F.transform(lines, lambda x: F.when(magic(x), F.concat(F.regexp_extract(x, "^( *)", 1), F.lit("pass"))).otherwise(x)), "\n")
    return F.array_join(F.filter(lines, lambda x: ~magic(x)), "\n")


def n_lines(code: Column) -> Column:
    return F.size(F.filter(F.split(code, "\n"), lambda x: F.trim(x) != ""))


#: General forms of plan labels and their templates, in order; {} is any text.
LABEL_FORMS = {
    "convert D1 to D2": "convert {} to {}", "function to do X": "function to do {}", "compute S": "compute {}", "create D": "create {}",
    "copy D": "copy {}", "populate D": "populate {}", "iterate over D": "iterate over {}", "data filtering": "data filtering conditison",
}


def generalised(label: Column) -> Column:
    """The general form of the first template that the whole label fits, letter case ignored; else the label."""
    out = label
    for form, template in reversed(LABEL_FORMS.items()):
        out = F.when(label.rlike("(?is)^" + template.replace("{}", ".+?") + r"\z"), form).otherwise(out)
    return out


def until_stop(x: Column, stops: list[str]) -> Column:
    """Text before the earliest stop token; all of it if there is none."""
    at = F.array_min(F.filter(F.array(*[F.instr(x, s) for s in stops]), lambda p: p > 0))
    return F.when(at.isNotNull(), F.substr(x, F.lit(1), at - 1)).otherwise(x)


def docstring_types(doc: Column) -> Column:
    """`name:type` of each `name (type):` line."""
    pattern = F.lit(r"(\w+)\s*\(([^)]+)\)\s*:")
    pairs = F.zip_with(F.regexp_extract_all(doc, pattern, 1), F.regexp_extract_all(doc, pattern, 2), lambda a, b: F.concat(a, F.lit(":"), b))
    return pairs


def around(words: Column, at: Column, k: int) -> Column:
    """The words from k before to k after a place (from 0)."""
    first = F.greatest(at - k, F.lit(0))
    return F.slice(words, first + 1, at + k + 1 - first)


def ascii_only(x: Column) -> Column:
    return F.regexp_replace(x, r"[^\x00-\x7F]", "")


def without_comments(code: Column) -> Column:
    """Line and block comments of C-like languages go, quoted strings stay."""
    quoted = r'"(?:\\.|[^"\\])*"' + "|" + r"'(?:\\.|[^'\\])*'"
    return F.regexp_replace(code, f"({quoted})|//[^\\n]*|(?s:/\\*.*?\\*/)", "$1")


#: Labels that stay whole, and labels that are dropped.
WHOLE_LABELS = [
    "impute missing data values, in order to preserve as much of the time series as possible",
    "set the index to a datetimeindex type",
    "computing alpha, beta, and r squared in python",
    "get the sse by using the predictions for every x y_hats and the true y values",
    "helper to create two separate dataframes for classification and regression",
    "using principal component analysis to plot in two dimensions",
    "how many rows and columns are in kallisto",
    "split a dataframe into a testing and a test set",
    "split up the data into a training set and a test set",
]
SKIPPED_LABELS = ["introduction", "linear", "load", "loading", "do exploratory data analysis", "bar charts", "assign it to a variable"]


def compound_parts(labels: DataFrame) -> DataFrame:
    """(label, parts): each distinct label with the parts that it is split into; itself if it isn't.

    A label is split at its first ` to ` if a part is a label itself, else at
    its only ` & ` (or, without one, ` and `) if a part of that is; else at the
    first whose parts have over two words each. Null and empty labels are left out.
    """
    x = labels.select("label").where("label <> ''").distinct()
    at = F.instr("label", " to ")
    both = F.when(F.col("label").contains(" & "), F.split("label", " & ")).otherwise(F.split("label", " and "))
    left, right = F.when(at > 0, F.substr("label", F.lit(1), at - 1)).otherwise(""), F.when(at > 0, F.substr("label", at + 4)).otherwise("")
    pair = lambda i: F.when(F.size(both) == 2, F.get(both, F.lit(i))).otherwise("")
    c = x.where((at > 0) | F.col("label").contains(" and ")).withColumn("p", F.array(left, right, pair(0), pair(1)))
    known = c.select("label", F.posexplode("p").alias("i", "part")).join(x.select(F.col("label").alias("part")), "part")
    known = known.groupBy("label").agg(F.bool_or(F.col("i") < 2).alias("to"), F.bool_or(F.col("i") > 1).alias("and"))
    several = F.transform("p", lambda v: F.size(F.filter(F.split(v, r"\s+"), lambda w: w != "")) > 2)
    to, also = F.slice("p", 1, 2), F.slice("p", 3, 2)
    parts = (
        F.when(F.col("label").isin(WHOLE_LABELS) | F.col("p").isNull(), F.array("label")).when(F.col("to"), to).when(F.col("and"), also)
        .when(F.get(several, F.lit(0)) & F.get(several, F.lit(1)), to).when(F.get(several, F.lit(2)) & F.get(several, F.lit(3)), also).otherwise(F.array("label"))
    )
    return x.join(c, "label", "left").join(known, "label", "left").select("label", parts.alias("parts"))


def simple_labels(labels: DataFrame) -> DataFrame:
    """(label): distinct labels after compound ones are split, without SKIPPED_LABELS."""
    return compound_parts(labels).select(F.explode("parts").alias("label")).distinct().where(~F.col("label").isin(SKIPPED_LABELS))
