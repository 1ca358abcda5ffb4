"""Text functions: tokens, sentences, fields of references, lexicons."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STOPWORDS = sorted("to we the a an and are as at be by for from has have in is it its of on or that their this with without our they them these those".split())
# cues are written as one text each, separated by bars
NEGATIVE = "does not|fail|failed|fails|no improvement|not |without improvement|worse".split("|")
GAP_CUES = "future work|limitation|limitations|need to|needs|not evaluated|not tested|open question|remain|remains|we do not|we leave".split("|")
METRICS = "accuracy|auc|auroc|bleu|f1|mae|mse|pnl|precision|recall|rmse|rouge|sharpe".split("|")
CLAIM_STEMS = "achieve|demonstrat|improv|increase|introduc|propos|reduce|show".split("|")
ASSUMPTIONS = "bounded inventory|gaussian noise|iid|infinite liquidity|no permanent impact|poisson|poisson arrivals|risk neutral|risk-neutral|stationary".split("|")
EVAL_DATASETS = "cifar-10|cifar10|imagenet|mnist|lobster|nyse|limit order book|synthetic".split("|")  # the first that is named counts
EVAL_METRICS = "accuracy|auc|f1|hit rate|mse|pnl|precision|profit|recall|rmse|sharpe".split("|")
CODE_CUES = "code available|github|gitlab|open source|open-source|released code|we release code".split("|")
DATA_CUES = "data available|data can be found|dataset available|released data|we release data".split("|")
CODE_HOSTS = "bitbucket|github|gitlab".split("|")
DATA_HOSTS = "data|dataverse|figshare|kaggle|osf.io|zenodo".split("|")
MODEL_HOSTS = "huggingface.co|model|weights".split("|")
STATISTICS = "anova|p value|p-value|statistically significant|t-test|wilcoxon".split("|")
INTERVALS = "confidence interval|error bar|standard deviation|std.".split("|")
URL = r"(?i)https?://[^\s)}\]]+"
DOI = r"(?i)\b10[.][0-9]{4,9}/[A-Z0-9()/:;._-]+\b"
ARXIV = r"(?i)\barxiv:\s*[0-9]{4}[.][0-9]{4,5}\b"
YEAR = r"\b(?:19|20)[0-9]{2}\b"


def collapse(t: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(t, F.lit("")), r"\s+", " "))


def tokens(t: Column) -> Column:
    """Lower-case runs of a-z and 0-9 of at least 3 characters, without stop words, in order."""
    stop = F.array(*map(F.lit, STOPWORDS))
    return F.filter(F.regexp_extract_all(F.lower(F.coalesce(t, F.lit(""))), F.lit("[a-z0-9]{3,}"), 0), lambda w: ~F.array_contains(stop, w))


def token_set(t: Column) -> Column:
    return F.array_distinct(tokens(t))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if either is empty."""
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.nullif(union, F.lit(0))).otherwise(F.lit(0.0))


def has_any(t: Column, cues) -> Column:
    """Whether the lower-case text contains one of the cues."""
    low = F.lower(F.coalesce(t, F.lit("")))
    found = F.lit(False)
    for c in cues:
        found = found | low.contains(c)
    return found


def sentences(t: Column) -> Column:
    """Pieces between sentence ends, without blank ones."""
    return F.filter(F.split(F.trim(F.coalesce(t, F.lit(""))), r"(?<=[.!?])\s+"), lambda s: F.length(F.trim(s)) > 0)


def claim_sign(t: Column) -> Column:
    return F.when(has_any(t, NEGATIVE), -1).otherwise(1)


def gap_sentences(t: Column, limit: int = 3) -> Column:
    return F.slice(F.filter(sentences(t), lambda s: has_any(s, GAP_CUES)), 1, limit)


def urls(t: Column) -> Column:
    """In order, without closing punctuation and repetitions."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(t, F.lit("")), F.lit(URL), 0), lambda u: F.regexp_replace(u, r"[).,;\]}]+$", "")))


def artifact_flags(t: Column, links: Column) -> Column:
    """code, data, model flags and the score .5 code + .4 data + .1 model."""
    host = lambda names: F.exists(links, lambda u: has_any(u, names))
    code = has_any(t, CODE_CUES) | host(CODE_HOSTS)
    data = has_any(t, DATA_CUES) | host(DATA_HOSTS)
    model = host(MODEL_HOSTS)
    return F.struct(code.alias("code"), data.alias("data"), model.alias("model"), (0.5 * code.cast("int") + 0.4 * data.cast("int") + 0.1 * model.cast("int")).alias("score"))


def rigor(t: Column, open_score: Column) -> Column:
    """A proxy of rigour in 0..1 from counts of ablations, baselines, statistics, figures and tables."""
    low = F.lower(F.coalesce(t, F.lit("")))
    part = lambda p, n: F.least(F.lit(1.0), F.regexp_count(low, F.lit(p)) / n)
    yes = lambda cues: has_any(low, cues).cast("int")
    score = (0.18 * part("ablation", 2) + 0.16 * part("baseline", 3)
             + 0.10 * yes(STATISTICS)
             + 0.10 * yes(INTERVALS) + 0.08 * yes(("limitation",))
             + 0.10 * part(r"\bfig(?:ure)?\s*\d+\b", 6) + 0.08 * part(r"\btable\s*\d+\b", 4) + 0.20 * F.least(F.lit(1.0), open_score))
    return F.least(F.lit(1.0), score)


def claims_of(t: Column) -> Column:
    """Sentences with a claim verb (strength .6); without any, the first sentence (.4)."""
    all_of = sentences(t)
    strong = F.filter(all_of, lambda s: has_any(s, CLAIM_STEMS))
    row = lambda k: lambda s: F.struct(F.trim(s).alias("statement"), F.lit(k).alias("strength"))
    return F.when(F.size(strong) > 0, F.transform(strong, row(0.6))).otherwise(F.transform(F.slice(all_of, 1, 1), row(0.4)))


def lexicon_hits(t: Column, lexicon) -> Column:
    low = F.lower(F.coalesce(t, F.lit("")))
    return F.array_compact(F.array(*[F.when(low.contains(w), F.lit(w)) for w in lexicon]))


def evaluation(t: Column) -> Column:
    """dataset, period and metrics named in a text."""
    low = F.lower(F.coalesce(t, F.lit("")))
    dataset = F.coalesce(*[F.when(low.contains(d), F.lit(d.upper() if d in ("cifar-10", "cifar10", "mnist", "lobster", "nyse") else d.title())) for d in EVAL_DATASETS])
    span = F.regexp_extract(low, r"(?:19|20)\d{2}\s*[-–]\s*(?:19|20)\d{2}", 0)
    one = F.regexp_extract(low, YEAR, 0)
    names = {"pnl": "PnL", "sharpe": "Sharpe ratio"}
    metrics = F.array_compact(F.array(*[F.when(low.contains(m), F.lit(names.get(m, m.capitalize()))) for m in EVAL_METRICS]))
    return F.struct(dataset.alias("dataset"), F.coalesce(F.nullif(span, F.lit("")), F.nullif(one, F.lit(""))).alias("period"), F.array_distinct(metrics).alias("metrics"))


def method_pipeline(t: Column) -> Column:
    """Five stages with what the text names for each."""
    low = F.lower(F.coalesce(t, F.lit("")))
    cascades = [
        ("data", [(("order book",), "Limit order book"), (("transaction",), "Transactions")], "Unspecified data"),
        ("preprocessing", [(("normalize", "standardize"), "Normalisation"), (("feature",), "Feature engineering")], "Basic cleaning"),
        ("model", [(("dqn",), "DQN"), (("actor-critic",), "Actor-critic"), (("transformer",), "Transformer"), (("hawkes",), "Hawkes process")], "Unspecified model"),
        ("objective", [(("sharpe",), "Sharpe ratio"), (("pnl", "profit"), "PnL"), (("cross entropy",), "Cross entropy")], "Unspecified objective"),
        ("evaluation", [(("sharpe",), "Sharpe ratio"), (("hit rate",), "Hit rate"), (("accuracy",), "Accuracy")], "Unspecified evaluation"),
    ]
    out = []
    for stage, options, default in cascades:
        value = F.lit(default)
        for cues, label in reversed(options):
            value = F.when(has_any(low, cues), F.lit(label)).otherwise(value)
        out.append(F.struct(F.lit(stage).alias("stage"), value.alias("label")))
    return F.array(*out)


def blueprint(pipeline: Column, title: Column, detail: bool = False) -> Column:
    """A text of numbered steps from (stage, label and, if there is one, detail) in order, between a heading and a note."""
    more = lambda s: F.coalesce(F.concat(F.lit(" — "), s["detail"]), F.lit("")) if detail else F.lit("")
    line = lambda s, i: F.concat(F.lit("Step "), (i + 1).cast("string"), F.lit(": ["), s["stage"], F.lit("] "), s["label"], more(s))
    lines = F.transform(pipeline, line)
    heading, note = F.concat(F.lit("Blueprint for "), F.coalesce(title, F.lit(""))), F.lit("Notes: Generated from method description; align reward/metrics with paper.")
    return F.array_join(F.concat(F.array(heading), lines, F.array(note)), "\n")


def first_sentence(t: Column, limit: int = 220) -> Column:
    return clip(F.element_at(F.concat(sentences(t), F.array(F.lit(""))), 1), limit)


def clip(t: Column, limit: int) -> Column:
    """At most `limit` characters, the last of which is an ellipsis where text was cut."""
    flat = collapse(t)
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, limit - 1)), F.lit("…")))


def infer_year(text: Column, file_name: Column, last_year: int) -> Column:
    """A standalone year in the text, else that of an arXiv-style YYMM number in the file name."""
    found = F.try_element_at(F.filter(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?<!\d)((?:19|20)\d{2})(?!\d)"), 1), lambda y: y.cast("int")), lambda y: (y >= 1900) & (y <= last_year)), F.lit(1))
    number = F.regexp_extract(F.coalesce(file_name, F.lit("")), r"(?<!\d)(\d{2})(0[1-9]|1[0-2])\.\d{4,5}", 1)
    return F.coalesce(found, F.when(number != "", F.expr("2000") + F.nullif(number, F.lit("")).cast("int")))


def infer_title(metadata: Column, text: Column, file_name: Column) -> Column:
    first = F.substring(F.trim(F.element_at(F.split(F.coalesce(text, F.lit("")), "\n"), 1)), 1, 120)
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.coalesce(blank(metadata), blank(first), blank(F.regexp_replace(file_name, r"\.[^.]*$", "")))


def clean_takeaways(items: Column) -> Column:
    """Bullets and numbers stripped, placeholders dropped unless all are, the first five."""
    stripped = F.filter(F.transform(items, lambda s: F.trim(F.regexp_replace(F.coalesce(s, F.lit("")), r"^\s*(?:[-*•]+|\d+[.)])\s*", ""))), lambda s: F.length(s) > 0)
    real = F.filter(stripped, lambda s: ~F.lower(s).rlike(r"^(?:takeaway|bullet|point|placeholder|n/a|todo)\s*\d*[.:]?$"))
    return F.slice(F.when(F.size(real) > 0, real).otherwise(stripped), 1, 5)


def string_list(value: Column) -> Column:
    """A list from text: split at line ends, commas and semicolons."""
    return F.filter(F.transform(F.split(F.coalesce(value, F.lit("")), r"[\n,;]"), lambda s: F.trim(s)), lambda s: F.length(s) > 0)


def lossy_number(value: Column) -> Column:
    """The first number in a text: "8/10" is 8."""
    return F.nullif(F.regexp_extract(F.coalesce(value, F.lit("")), r"-?\d+(?:\.\d+)?", 0), F.lit("")).cast("double")


def tag_text(tags: Column, assumptions: Column, steps: Column) -> Column:
    return F.concat_ws(" ", tags, assumptions, steps)


def fill_template(template: str, values: dict[str, Column]) -> Column:
    out = F.lit(template)
    for k, v in values.items():
        out = F.replace(out, F.lit("{{" + k + "}}"), F.coalesce(v, F.lit("")))
    return out
