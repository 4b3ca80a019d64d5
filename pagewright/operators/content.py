"""Content checks by a scorer from outside (a model behind a function): which keywords, what is asked, what is read from answers.

The scorer is a function from a list of prompts to a list of answers; it runs in Arrow batches, so a lost executor's batch is asked
again. Nothing here knows a service.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..plans.rules import CONTENT_RULES, evaluate

MOST_CALLS = 10
HEADINGS = 10
QUESTION = "Keyword: {keyword}\nURL: {url}\nTitle: {title}\nH1: {h1}\nWords: {words}\n\n{preview}\n\nAnswer as JSON with intent_match, intent_type, geo_readiness and content_gaps."
ANSWER = "intent_match int, intent_type string, intent_explanation string, geo_readiness int, geo_explanation string, content_gaps array<string>, suggested_improvements array<string>"


def preview(title: Column, description: Column, h1: Column, h2: Column) -> Column:
    """What is known of a page, line by line; at most HEADINGS second headings."""
    line = lambda name, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(name + ": "), c))
    none = F.array().cast("array<string>")
    lines = F.concat(F.array_compact(F.array(line("Title", title), line("Description", description))), F.transform(F.coalesce(h1, none), lambda x: F.concat(F.lit("H1: "), x)), F.transform(F.slice(F.coalesce(h2, none), 1, HEADINGS), lambda x: F.concat(F.lit("H2: "), x)))
    return F.when(F.size(lines) > 0, F.array_join(lines, "\n")).otherwise("(no content available)")


def prompts(keywords: DataFrame, pages: DataFrame, question: str = QUESTION) -> DataFrame:
    """``keywords(keyword, url, position, impressions, clicks)`` with a prompt each; a keyword whose page was not crawled is asked
    about its address alone."""
    p = pages.groupBy("url").agg(F.max_by(F.struct("title", "meta_description", "h1", "h2", "word_count"), "ord").alias("p"))
    d = keywords.join(p, "url", "left")
    text = F.lit(question)
    given = {"{keyword}": F.col("keyword"), "{url}": F.col("url"), "{title}": F.col("p.title"), "{h1}": F.get("p.h1", F.lit(0)), "{words}": F.coalesce("p.word_count", F.lit(0)).cast("string"), "{preview}": preview(F.col("p.title"), F.col("p.meta_description"), F.col("p.h1"), F.col("p.h2"))}
    for mark, value in given.items():
        text = F.replace(text, F.lit(mark), F.coalesce(value, F.lit("")))
    return d.select(*keywords.columns, text.alias("prompt"))


def answered(asked: DataFrame, scorer: Callable[[list[str]], list[str]]) -> DataFrame:
    """``asked(prompt, ...)`` with the scorer's answers; an answer that is an exception becomes ``call_error``."""
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in asked.schema.fields)}, answer string, call_error string"

    def run(batches: Iterator):
        for pdf in batches:
            try:
                got, errors = list(scorer(pdf["prompt"].tolist())), [None] * len(pdf)
            except Exception:  # one at a time, so that only the failing ones are lost
                got, errors = [], []
                for prompt in pdf["prompt"]:
                    try:
                        got.append(scorer([prompt])[0])
                        errors.append(None)
                    except Exception as e:
                        got.append(None)
                        errors.append(str(e)[:500])
            yield pdf.assign(answer=got, call_error=errors)

    return asked.mapInPandas(run, schema)


def unfenced(answer: Column) -> Column:
    """An answer without the lines of a code fence around it."""
    bare = tx.strip(answer)
    lines = F.filter(F.split(bare, "\n"), lambda x: ~F.startswith(tx.strip(x), F.lit("```")))
    return F.when(F.startswith(bare, F.lit("```")), tx.strip(F.array_join(lines, "\n"))).otherwise(bare)


def parsed(answers: DataFrame) -> DataFrame:
    """``answers(answer, call_error, ...)`` taken apart; what is no JSON object has an error and no scores."""
    text = unfenced(F.col("answer"))
    good = F.coalesce(F.schema_of_variant(F.try_parse_json(text)).startswith("OBJECT<") & (F.schema_of_variant(F.try_parse_json(text)) != "OBJECT<>"), F.lit(False))
    d = answers.withColumn("_a", F.when(good, F.from_json(text, ANSWER))).withColumn("error", F.coalesce("call_error", F.when(~good, "the answer is no JSON object")))
    score = lambda c: F.when(F.col("error").isNull(), F.coalesce(f"_a.{c}", F.lit(0))).alias(c)
    none = F.array().cast("array<string>")
    return d.select(*[c for c in answers.columns if c not in ("answer", "call_error")], "error", score("intent_match"), score("geo_readiness"), F.coalesce("_a.intent_type", F.lit("")).alias("intent_type"),
                    F.coalesce("_a.content_gaps", none).alias("content_gaps"), F.coalesce("_a.suggested_improvements", none).alias("suggested_improvements"))


def content_issues(results: DataFrame) -> DataFrame:
    """Issues of the keywords that were scored."""
    d = results.filter("error IS NULL").withColumn("n_gaps", F.size("content_gaps"))
    return evaluate(d, CONTENT_RULES, "keyword", "url").withColumnRenamed("url", "affected_url")


def averages(results: DataFrame) -> DataFrame:
    """calls, analysed keywords, and the mean scores of those without error (0 where there are none)."""
    mean = lambda c: F.coalesce(F.avg(F.when(F.col("error").isNull(), F.col(c))), F.lit(0.0)).alias("avg_" + c)
    return results.agg(F.count(F.lit(1)).alias("keywords_analyzed"), F.count_if(F.col("error").isNull()).alias("scored"), mean("intent_match"), mean("geo_readiness"))


def scored(keywords: DataFrame, pages: DataFrame, scorer: Callable[[list[str]], list[str]], most: int = MOST_CALLS) -> DataFrame:
    """The first ``most`` keywords, by impressions, with what the scorer says."""
    first = keywords.orderBy(F.col("impressions").desc(), "keyword").limit(most)
    return parsed(answered(prompts(first, pages), scorer))


def risk_answers(answers: DataFrame) -> DataFrame:
    """risk_level and actions read from the lines ``RISK:`` and ``ACTION...:`` of ``answers(answer, ...)``: the last valid risk
    counts, LOW where there is none."""
    lines = F.transform(F.split(F.coalesce(F.col("answer"), F.lit("")), r"\r\n|\r|\n"), tx.strip)
    after = lambda x: tx.strip(F.regexp_extract(x, "^[^:]*:(.*)$", 1))
    risks = F.filter(F.transform(F.filter(lines, lambda x: F.startswith(x, F.lit("RISK:"))), lambda x: F.upper(after(x))), lambda x: x.isin("LOW", "MEDIUM", "HIGH"))
    actions = F.filter(F.transform(F.filter(lines, lambda x: F.startswith(x, F.lit("ACTION"))), after), lambda x: x != "")
    return answers.withColumn("risk_level", F.coalesce(F.try_element_at(risks, F.lit(-1)), F.lit("LOW"))).withColumn("actions", actions)
