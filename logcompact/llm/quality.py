"""Quality of documents: evidence of each, and what is known of the sites they come from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logcompact.llm.common import WORD, text_or_empty
from logcompact.session import Scratch

#: Added to each count of a feature's bin, so that bins without labels say nothing.
SMOOTHING = 1.0
#: Added to the words that counts are divided by: a few words say little.
FEW = 10
#: Documents below are rejected.
LEAST = 0.3

COUNTED = {  # what is counted per word; quantifiers don't give back, so long texts without spaces cost no more
    "capitals": r"\p{Lu}{2,}+",
    "marks": r"[^\p{L}\p{N}\s.,;:'\"()-]++",
    "doubled": r"(?<!\S)(\S++)\s++\1(?!\S)",
    "digits": r"\p{N}++",
    "stops": r"[.!?](?=\s|$)",
    "small_starts": r"(?m)^\p{Ll}",
}


def features(text: Column) -> dict[str, Column]:
    """Bins of a text's measures: each one a small whole number, -1 where there are no words."""
    words = F.regexp_count(text, F.lit(WORD))
    rate = lambda c: F.floor(2 * F.log2(1 + 1000 * c / (words + FEW))).cast("int")
    out = {k: rate(F.regexp_count(text, F.lit(p))) for k, p in COUNTED.items()}
    out["word_length"] = F.least(F.floor(2 * F.char_length(text) / words), F.lit(60)).cast("int")
    out["words"] = F.floor(F.log2(words)).cast("int")
    return {k: F.when(words > 0, v).otherwise(-1) for k, v in out.items()}


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def _strength(sites: DataFrame, prior: Column | float, n: str, s: str) -> float:
    """How many documents' worth of the prior a site gets, from how far sites differ more than chance makes them.

    Moments of the beta-binomial; between 1 and 10,000.
    """
    x = sites.agg(
        F.sum(n).alias("n"), F.count(F.lit(1)).alias("k"), F.sum(F.col(n) * F.col(n)).alias("nn"),
        F.sum(F.col(n) * F.pow(F.col(s) / F.col(n) - prior, 2)).alias("between"),
        (F.sum(F.col(n) * prior * (1 - prior)) / F.sum(n)).alias("spread"),
    ).first()
    if not x["n"] or x["k"] < 2 or x["n"] * x["n"] <= x["nn"]:
        return 10.0
    variance = (x["between"] - (x["k"] - 1) * x["spread"]) / (x["n"] - x["nn"] / x["n"])
    return float(min(max(x["spread"] / max(variance, 1e-9) - 1, 1.0), 1e4))


def score_quality(
    docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", least: float = LEAST
) -> DataFrame:
    """The probability that a document is good: its own evidence with its site's prior.

    1. Evidence: measures of the text in bins; the log of how much likelier each bin is in documents labelled good, summed.
       Learned from all labelled documents with one grouped count.
    2. Sites: each document's probability under the global prior (its label where it has one) is summed per host and per
       path on it. A host's rate is shrunk to the global one and a path's to its host's, by as many documents' worth as the
       differences between sites call for, so sparse sites say little.
    3. The posterior joins evidence and the path's rate, from which the document itself is left out.

    All sums are grouped aggregates that add up before the shuffle, so a hot host costs nothing, and sites are joined, not
    broadcast by hint. The driver reads totals and the table of bins (a few hundred rows).

    Null and empty texts have bins of their own (-1). Null hosts and paths are sites like others. Labels are the mean per
    doc_id where there are several; null labels and labels of unknown documents are left out. Without labels of both kinds there is no
    evidence, and everything is kept at 0.5. Repeated rows are rated each. Columns other than doc_id, text, host and path
    are not read. Returns doc_id, evidence, host_rate, path_rate, quality, keep.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    text = features(F.col("_text"))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("_text"),
        F.coalesce(F.col(host).cast("string"), F.lit("\x00")).alias("host"),
        F.coalesce(F.col(path).cast("string"), F.lit("\x00")).alias("path"),
    )
    rows = rows.select("doc_id", "host", "path", F.array(*text.values()).alias("bins"))
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("_id"))
    known = known.agg(F.avg(F.col("quality").cast("double")).alias("label"))
    rows = scratch.write(rows.join(known, F.col("doc_id") == F.col("_id"), "left").drop("_id"), "bins")

    seen = rows.where("label IS NOT NULL").select("label", F.posexplode("bins").alias("feature", "bin"))
    good, bad = F.sum("label").alias("good"), F.sum(1 - F.col("label")).alias("bad")
    counts = seen.groupBy("feature", "bin").agg(good, bad).collect()
    of_one = [r for r in counts if r["feature"] == 0]
    n_good, n_bad = sum(r["good"] for r in of_one), sum(r["bad"] for r in of_one)
    prior = n_good / (n_good + n_bad) if n_good and n_bad else 0.5
    evidence = F.lit(0.0)
    if n_good and n_bad:
        for k in range(len(text)):
            bins = [r for r in counts if r["feature"] == k]
            more = SMOOTHING * len(bins)
            weigh = F.lit(0.0)
            table = {}
            for r in bins:
                # a bin seen as often as the prior says weighs nothing; the added counts follow the prior too
                p = (r["good"] + 2 * SMOOTHING * prior) / (n_good + 2 * more * prior)
                q = (r["bad"] + 2 * SMOOTHING * (1 - prior)) / (n_bad + 2 * more * (1 - prior))
                table[r["bin"]] = p / q
            pairs = [x for b, v in sorted(table.items()) for x in (F.lit(b), F.lit(float(v)))]
            weigh = F.log(F.coalesce(F.element_at(F.create_map(*pairs), F.col("bins")[k]), F.lit(1.0)))
            evidence = evidence + weigh
    rows = rows.select("doc_id", "host", "path", "label", evidence.alias("evidence"))
    alone = 1 / (1 + F.exp(-(F.col("evidence") + _logit(F.lit(prior)))))
    rows = scratch.write(rows.withColumn("p", F.coalesce("label", alone)), "evidence")

    paths = scratch.write(rows.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("s")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("s").alias("host_s"))
    total = hosts.agg(F.sum("host_s") / F.sum("host_n")).first()[0]
    total = 0.5 if total is None else total
    k_host = _strength(hosts, F.lit(total), "host_n", "host_s")
    hosts = hosts.withColumn("host_rate", (F.col("host_s") + k_host * total) / (F.col("host_n") + k_host))
    sites = scratch.write(paths.join(hosts.select("host", "host_rate"), "host"), "sites")
    k_path = _strength(sites, F.col("host_rate"), "n", "s")
    rated = rows.join(sites, ["host", "path"])
    path_rate = (F.col("s") - F.col("p") + k_path * F.col("host_rate")) / (F.col("n") - 1 + k_path)
    # the evidence is against the labelled documents' mean, so the site moves it by what it differs from that of all sites
    shift = _logit(path_rate) - _logit(F.lit(total))
    quality = 1 / (1 + F.exp(-(F.col("evidence") + _logit(F.lit(prior)) + shift)))
    out = rated.select("doc_id", "evidence", "host_rate", path_rate.alias("path_rate"), quality.alias("quality"))
    return out.withColumn("keep", F.col("quality") >= least)
