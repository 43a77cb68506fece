"""Mixing sources to target shares of the total size."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .encode import VOCABULARIES, VOCABULARY, encode, encoder

#: Token ids are hashed to so many features of the classifier.
FEATURES = 1 << 14
#: Texts of a source that the classifier is fitted on, about, chosen by a hash. Only the fit is bounded.
TRAIN_TEXTS = 2000
#: Sharpness tried for the posteriors, as a factor and a power of the length that divides it (words of long texts are less independent); the best on held-out labelled texts is taken.
SHARPNESS = ((1.0, 0.0), (0.3, 0.0), (0.1, 0.0), (0.03, 0.0), (0.01, 0.0), (3.0, 0.5), (1.0, 0.5), (0.3, 0.5), (30.0, 1.0), (10.0, 1.0), (3.0, 1.0))
#: One text in so many of these is held out for that.
HELD_OUT = 10
#: Share of labels taken to be wrong, unless told otherwise.
LABEL_NOISE = 0.01
#: Memberships are multiples of one part in GRID.
GRID = 64
#: Steps of the projected gradient at most, and the change of the sizes at which it ends.
STEPS, ENOUGH = 60, 1e-5
#: Bins of the draw for a factor of two.
OCTAVE = 64
#: More sources than this are an error: a row of targets goes to the driver and a column of the classifier to every task.
MOST_SOURCES = 1024


@dataclass
class Classifier:
    """Multinomial naive Bayes over hashed token ids."""

    log_prior: np.ndarray  # (domains,)
    log_word: np.ndarray  # (features, domains)
    sharpness: tuple[float, float] = SHARPNESS[0]
    #: Share of texts that speak for a wrong domain.
    error: float = 0.0

    def logs(self, ids: np.ndarray) -> np.ndarray:
        return self.log_word[ids % len(self.log_word)].sum(axis=0, dtype=np.float64)

    def posterior(self, ids: np.ndarray, sharpness: tuple[float, float] | None = None) -> np.ndarray:
        factor, power = sharpness or self.sharpness
        z = self.log_prior + factor * self.logs(ids) / max(1, len(ids)) ** power
        p = np.exp(z - z.max())
        return p / p.sum()


def fit_classifier(rows: DataFrame, domains: int, vocabulary: str, features: int = FEATURES, texts: int = TRAIN_TEXTS) -> Classifier:
    """Fitted on about ``texts`` texts of each domain among the labelled ``(doc, domain, text)``.

    The driver gets a count per domain and feature (``domains * features`` numbers), added up
    per batch and then per task. Of equal sharpness the first is taken; without held-out texts, too.
    """
    labelled = rows.where("domain >= 0 and length(text) > 0")
    sizes = {r.domain: r.n for r in labelled.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.element_at(F.array(*(F.lit(min(1.0, texts / max(1, sizes.get(k, 0)))) for k in range(domains))), F.col("domain") + 1)
    u = F.pmod(F.xxhash64("doc", F.lit("train")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = labelled.where(u < share).select(F.struct("doc", "domain").alias("row"), "text")
    tokens = written(encode(chosen, "row", "text", vocabulary=vocabulary).select("row.doc", "row.domain", "ids"))
    held = F.pmod(F.xxhash64("doc", F.lit("held out")), F.lit(HELD_OUT)) == 0

    def counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k, ids in b.groupby("domain")["ids"]:
                n = np.bincount(np.concatenate(ids.to_numpy()) % features, minlength=features)
                at = np.flatnonzero(n)
                yield pd.DataFrame({"domain": k, "feature": at, "n": n[at]})

    found = tokens.where(~held).select("domain", "ids").mapInPandas(counts, "domain int, feature int, n long").groupBy("domain", "feature").agg(F.sum("n").alias("n")).toPandas()
    word = np.full((domains, features), 0.1)
    np.add.at(word, (found["domain"].to_numpy(int), found["feature"].to_numpy(int)), found["n"].to_numpy(float))
    prior = np.array([sizes.get(k, 0) + 0.5 for k in range(domains)])
    model = Classifier(np.log(prior / prior.sum()), np.ascontiguousarray(np.log(word / word.sum(axis=1, keepdims=True)).T, dtype=np.float32))

    def losses(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, wrong, n = np.zeros(len(SHARPNESS)), np.zeros(len(SHARPNESS)), 0
        for b in batches:
            for k, ids in zip(b["domain"], b["ids"]):
                p = np.stack([model.posterior(np.asarray(ids, dtype=np.int64), s) for s in SHARPNESS])
                total += np.log(p[:, k] + 1e-12)
                wrong += p.argmax(axis=1) != k
                n += 1
        yield pd.DataFrame({"s": range(len(SHARPNESS)), "fit": total, "wrong": wrong, "n": n})

    sums = tokens.where(held).select("domain", "ids").mapInPandas(losses, "s int, fit double, wrong double, n long").groupBy("s").agg(*(F.sum(c).alias(c) for c in ("fit", "wrong", "n")))
    fit = sums.where("n > 0").orderBy(F.desc("fit"), "s").limit(1).collect()
    if fit:
        model.sharpness, model.error = SHARPNESS[fit[0].s], fit[0].wrong / fit[0].n
    return model


def membership(model: Classifier, ids: list[int], domain: int | None, noise: float) -> np.ndarray:
    """Share of a text in each domain, on the grid: its posterior by its tokens and, where it has one, its label.

    A label is the right one but for ``noise``, when it is drawn by the sources' sizes, and the
    posterior but for the classifier's error on held-out texts, when it says nothing. So a
    label decides most of it, and all where the text does not speak against it.
    """
    prior = np.exp(model.log_prior)
    p = (1.0 - model.error) * model.posterior(np.asarray(ids, dtype=np.int64)) + model.error * prior
    if domain is not None:
        channel = np.full(len(p), noise * prior[domain])
        channel[domain] += 1.0 - noise
        p = p * channel
        p /= p.sum()
    q = np.floor(p * GRID + 0.5)
    if not q.any():
        q[p.argmax()] = 1.0
    return q / q.sum()


def memberships(rows: DataFrame, model: Classifier, vocabulary: str, noise: float) -> DataFrame:
    """``(doc, domain, size, p)`` of ``(doc, domain, text)``: size in tokens and membership. Texts are encoded once, their ids not kept."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder, own = encoder(vocabulary), shared.value
        for b in batches:
            sizes, p = [], []
            for k, text in zip(b["domain"], b["text"]):
                ids = coder.ids(text)
                sizes.append(len(ids))
                p.append(membership(own, ids, None if pd.isna(k) else int(k), noise))
            yield pd.DataFrame({"doc": b["doc"], "domain": b["domain"].astype("Int32"), "size": sizes, "p": p})

    kind = rows.schema["doc"].dataType.simpleString()
    return rows.where("length(text) > 0").select("doc", "domain", "text").mapInPandas(run, f"doc {kind}, domain int, size long, p array<double>")


def _rates(p: np.ndarray, cap: np.ndarray, history: np.ndarray) -> np.ndarray:
    """Rates after the steps whose gradients, one number per domain, ``history`` holds."""
    rate = np.zeros(len(cap))
    for g in history:
        rate = np.clip(rate - p @ g, 0.0, cap)
    return rate


def fit_rates(groups: DataFrame, target: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Projected-gradient least squares for the rates of ``groups (p, cap, size)``.

    Minimises the sum over domains of ``(reached - target)**2 / held``, where ``reached`` is
    the expected size of a domain in the mixture, for rates between 0 and ``cap``. In the
    metric of the sizes the step length 1 never overshoots. A rate follows from its group's
    ``p`` and ``cap`` and the gradients so far, so these few numbers are the only state; each
    step is one pass in which every partition adds up its sizes. Returns the gradients.
    """
    history = np.zeros((0, len(target)))
    scale = np.maximum(held, 1e-9)
    for _ in range(STEPS):

        def reached(batches: Iterator[pd.DataFrame], past: np.ndarray = history) -> Iterator[pd.DataFrame]:
            total = np.zeros(len(target))
            for b in batches:
                p = np.stack(b["p"].to_numpy())
                total += (_rates(p, b["cap"].to_numpy(float), past) * b["size"].to_numpy(float)) @ p
            yield pd.DataFrame({"k": range(len(total)), "t": total})

        sums = groups.mapInPandas(reached, "k int, t double").groupBy("k").sum("t").collect()
        now = np.zeros(len(target))
        for k, t in sums:
            now[k] = t
        gradient = np.where(held > 0, (now - target) / scale, 0.0)
        if len(history) and np.abs(gradient - history[-1]).max() < ENOUGH:
            break
        history = np.vstack([history, gradient])
    return history


def _cuts(bins: pd.DataFrame) -> pd.DataFrame:
    """For each size class of a stratum, the bin from which on texts do not get one repeat more.

    From the largest class down, each takes what its rates and the rest of the classes above
    ask for, as nearly as whole texts allow, and hands on what is missing or too much.
    """
    out, carry = [], 0.0
    for c, b in sorted(bins.groupby("class"), key=lambda x: -x[0]):
        b = b.sort_values("bin")
        full = np.concatenate([[0.0], b["size"].to_numpy(float).cumsum()])
        ends = [*b["bin"].tolist(), int(b["bin"].iloc[-1]) + 1]
        want = carry + float(b["want"].sum())
        k = int(np.abs(full - want).argmin())
        carry = want - full[k]
        out.append((int(b["stratum"].iloc[0]), int(c), int(ends[k])))
    return pd.DataFrame(out, columns=["stratum", "class", "cut"])


def rounded(rated: DataFrame) -> DataFrame:
    """``rated(doc, stratum, size, rate)`` with whole ``repeats``, by error-carrying rounding per stratum and size class.

    Every text gets the whole part of its rate. One more goes to those whose hash is small
    against the rest of their rate, up to a cut per stratum and size class (powers of two) by
    which the sizes come out as the rates say, but for about half of the smallest class's text
    or, where there are many, bin. What is brought together for that is a row per bin.
    """
    u = (F.pmod(F.xxhash64("doc", F.lit("mix")), F.lit(1 << 30)) + 1) / F.lit(float(1 << 30))
    whole = F.floor(F.col("rate") + 1e-6)
    rest = F.greatest(F.col("rate") - whole, F.lit(0.0))
    some = rated.withColumn("whole", whole).withColumn("rest", F.when(rest > 1e-6, rest).otherwise(0.0)).withColumn("class", F.floor(F.log2("size")).cast("int"))
    some = some.withColumn("bin", F.when(F.col("rest") > 0, F.floor(F.log2(u / F.col("rest")) * OCTAVE).cast("int")))
    bins = some.where("rest > 0").groupBy("stratum", "class", "bin").agg(F.sum(F.col("rest") * F.col("size")).alias("want"), F.sum("size").alias("size"))
    cuts = bins.groupBy("stratum").applyInPandas(_cuts, "stratum int, class int, cut int")
    one = F.coalesce(F.col("bin") < F.col("cut"), F.lit(False)).cast("long")
    return some.join(F.broadcast(cuts), ["stratum", "class"], "left").withColumn("repeats", (F.col("whole") + one).cast("int")).drop("whole", "rest", "bin", "cut", "class")


def mix(
    df: DataFrame, key: str, text: str, source: str, targets: DataFrame, *, total_tokens: float | None = None,
    label_noise: float = LABEL_NOISE, vocabulary: str = f"{VOCABULARIES}/{VOCABULARY}",
) -> tuple[DataFrame, DataFrame]:
    """The mixture and its shares.

    Mixture: ``(key, source, tokens, repeats)``, a row for each text that is taken, ``source``
    null where it has none. Shares: ``(source, target_share, max_repeats, n_texts, n_taken,
    tokens_held, tokens_taken, actual_share, expected_share)``, a row for each source of
    ``targets(source, target_share, max_repeats)``; tokens and actual shares go by label,
    and by membership for texts without; the expected share by membership for all.

    ``total_tokens`` is the size aimed at; by default the largest at which each source that has
    labelled texts can have its share without a text being repeated more than its
    ``max_repeats``. A source without labelled texts gets nothing but what texts may belong to
    it by their words, and the others keep their proportions.

    A classifier fitted on labelled texts gives every text a membership in the domains, which a
    label narrows but for ``label_noise``. Projected-gradient least squares then fits
    nonnegative rates, at most ``max_repeats`` of the label (or likeliest domain), whose
    expected sizes meet the targets; texts of equal membership have equal rates and are
    aggregated first, so a step passes over groups, not texts. Rates become whole repeats by
    ``rounded``, in strata of the likeliest domain: first those of texts that belong
    to several domains, then, fitted once more to what these leave, those of all others. Texts and tokens are read once for
    the memberships, besides those the classifier is fitted on.

    Null and empty texts have no tokens and are never taken; repeated texts are texts of their
    own. Rows with a null key are left out, sources not in ``targets`` never taken, targets with
    a null source, share or repeats ignored; more than ``MOST_SOURCES`` targets are an error.
    """
    named = targets.where("source is not null and target_share is not null and max_repeats is not null")
    wanted = named.groupBy("source").agg(F.sum("target_share").alias("share"), F.min("max_repeats").alias("cap")).orderBy("source").limit(MOST_SOURCES + 1).collect()
    if len(wanted) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources in the targets")
    names, share, caps = [r.source for r in wanted], np.array([r.share for r in wanted], float), np.array([max(0, r.cap) for r in wanted], float)
    spark, K = df.sparkSession, len(names)
    index = spark.createDataFrame([(n, k) for k, n in enumerate(names)], "source string, domain int")
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).alias("doc"), F.col(source).alias("source"), F.col(text).alias("text")).join(F.broadcast(index), "source", "left")
    known = rows.where("source is null or domain is not null").select("doc", "domain", "text")
    if not K:
        nothing = known.limit(0).select(F.col("doc").alias(key), F.lit("").alias("source"), F.lit(0).cast("long").alias("tokens"), F.lit(0).alias("repeats"))
        numbers = "target_share double, max_repeats int, n_texts long, n_taken long, tokens_held double, tokens_taken double, actual_share double, expected_share double"
        return nothing, spark.createDataFrame([], f"source string, {numbers}")

    model = fit_classifier(known, K, vocabulary)
    member = written(memberships(known, model, vocabulary, label_noise)).where("size > 0")
    stratum = F.array_position("p", F.array_max("p")).cast("int") - 1
    cap = F.element_at(F.array(*(F.lit(float(c)) for c in caps)), F.coalesce("domain", stratum) + 1)
    member = member.withColumn("stratum", stratum).withColumn("cap", cap)
    groups = written(member.groupBy("p", "cap").agg(F.sum("size").alias("size")))

    held, labelled = np.zeros(K), np.zeros(K)
    for k, t in groups.select(F.posexplode("p").alias("k", "q"), "size").groupBy("k").agg(F.sum(F.col("q") * F.col("size"))).collect():
        held[k] = t
    for k, t in member.where("domain is not null").groupBy("domain").agg(F.sum("size")).collect():
        labelled[k] = t
    live = (labelled > 0) & (share > 0) & (caps > 0)
    weight = np.where(live, share, 0.0)
    weight = weight / weight.sum() if weight.sum() else weight
    total = total_tokens if total_tokens is not None else min((caps[k] * labelled[k] / weight[k] for k in range(K) if live[k]), default=0.0)
    target = weight * total

    def whole(texts: DataFrame, history: np.ndarray) -> DataFrame:
        @F.pandas_udf("double")
        def rate_of(p: pd.Series, c: pd.Series) -> pd.Series:
            return pd.Series(_rates(np.stack(p.to_numpy()), c.to_numpy(float), history) if len(p) else [], dtype=float)

        return rounded(texts.withColumn("rate", rate_of("p", "cap")))

    # Texts of several domains first; what rounding made of them is then fixed, and the rates of the others are fitted to what it leaves.
    several = F.array_max("p") < 1
    soft = written(whole(member.where(several), fit_rates(groups, target, np.where(live, held, 0.0))))
    used, left = np.zeros(K), held.copy()
    for k, t, own in soft.select(F.posexplode("p").alias("k", "q"), "size", "repeats").groupBy("k").agg(F.sum(F.col("q") * F.col("size") * F.col("repeats")), F.sum(F.col("q") * F.col("size"))).collect():
        used[k], left[k] = t, held[k] - own
    hard = whole(member.where(~several), fit_rates(groups.where(~several), target - used, np.where(live, left, 0.0)))
    done = soft.unionByName(hard)
    label = F.element_at(F.array(*(F.lit(n) for n in names)), F.col("domain") + 1)
    mixture = done.where("repeats > 0").select(F.col("doc").alias(key), F.when(F.col("domain").isNotNull(), label).alias("source"), F.col("size").alias("tokens"), "repeats")
    one = F.transform(F.sequence(F.lit(0), F.lit(K - 1)), lambda k: (k == F.col("domain")).cast("double"))
    own = F.when(F.col("domain").isNotNull(), one).otherwise(F.col("p"))
    sums = done.select(F.inline(F.arrays_zip(own.alias("own"), F.col("p").alias("q"), F.sequence(F.lit(0), F.lit(K - 1)).alias("k"))), "size", "repeats", F.col("domain").alias("d"))
    per = sums.groupBy("k").agg(
        F.sum((F.col("d") == F.col("k")).cast("long")).alias("n_texts"),
        F.sum(((F.col("d") == F.col("k")) & (F.col("repeats") > 0)).cast("long")).alias("n_taken"),
        F.sum(F.col("own") * F.col("size")).alias("tokens_held"),
        F.sum(F.col("own") * F.col("size") * F.col("repeats")).alias("tokens_taken"),
        F.sum(F.col("q") * F.col("size") * F.col("repeats")).alias("expected"),
    )
    wants = spark.createDataFrame([(k, n, float(share[k]), int(caps[k])) for k, n in enumerate(names)], "k int, source string, target_share double, max_repeats int")
    alone = Window.partitionBy(F.lit(0))  # a row for each source
    part = lambda c: F.round(F.coalesce(F.try_divide(c, F.sum(c).over(alone)), F.lit(0.0)), 6)
    shares = wants.join(per, "k", "left").select(
        "source", "target_share", "max_repeats",
        *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_texts", "n_taken")),
        *(F.round(F.coalesce(c, F.lit(0.0)), 3).alias(c) for c in ("tokens_held", "tokens_taken")),
        part("tokens_taken").alias("actual_share"), part("expected").alias("expected_share"),
    )
    return mixture, shares
