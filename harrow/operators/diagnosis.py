"""Diagnosis of failed runs: up to three attempts of a run, what each saw, and whether to repair the job or to raise.

``attempts`` has (run_id, attempt_no from 1, success, error, exit_code, schema_error, http_status, page_url, content,
headers, cookies, target_url, mode). One aggregation by run_id; everything else is a chain of conditions on its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrow.functions import failures, pages
from harrow.functions.regex import strip

MAX_ATTEMPTS = 3
# What categories, patterns and verdicts are called in messages.
CATEGORY_LABELS = {
    "A": "Parse error", "B": "Runtime crash", "C": "Network/server failure", "D": "Selector timeout", "E": "Page state error", "F1": "Browser/page crash",
    "F2": "Subprocess timeout", "F3": "Infrastructure failure", "G": "Schema validation failure",
}
TAINTS = ("server_error", "soft_block", "redirected", "no_response")
NEVER_REASONS = {
    "C": "Network/server failure (Category C) — page never loaded, a new script needs the same server to be up",
    "F1": "Browser/page crash (Category F1) — a new script runs in the same browser environment and will likely crash too",
    "F2": "Subprocess timeout (Category F2) — diagnostic cost prohibitive, not retrying",
    "F3": "Infrastructure failure (Category F3) — no script can execute until the infrastructure is repaired",
}
#: (tier, stability, all pages real) -> the modes that repair.
REPAIRS = {
    (1, "stable", True): ("cautious", "balanced", "eager"),
    (1, "stable", False): ("balanced", "eager"),
    (1, "consistent", True): ("cautious", "balanced", "eager", "always"),
    (1, "consistent", False): ("eager",),
    (2, "stable", True): ("balanced", "eager", "always"),
    (2, "stable", False): ("eager",),
    (2, "consistent", True): ("eager",),
    (2, "consistent", False): (),
}
REPAIRS[1, "stable", True] += ("always",)


def examined(attempts: DataFrame) -> DataFrame:
    """attempts with category, fingerprint and page_result of each failed one. No shuffle."""
    df = attempts.withColumn("category", F.when(~F.col("success"), failures.classify_error(F.col("error"), F.col("exit_code"), F.col("schema_error"))))
    df = df.withColumn("fingerprint", F.when(~F.col("success"), failures.extract_fingerprint(F.col("error"), F.col("category"), F.col("schema_error"))))
    verdict = pages.verify_page(*[F.col(c) for c in ("http_status", "page_url", "content", "headers", "cookies", "target_url")])
    return df.withColumn("page_result", F.when(~F.col("success"), verdict))


def stability_of(prints: Column) -> Column:
    """stable, consistent, mixed or chaotic, of an array of fingerprints; null for fewer than two."""
    categories = F.array_distinct(F.transform(prints, lambda p: p["category"]))
    kinds = F.array_distinct(F.transform(prints, lambda p: F.struct(p["error_type"], p["method"])))
    first = F.size(F.filter(prints, lambda p: p["category"] == F.try_element_at(categories, F.lit(1))))
    return (
        F.when(F.size(prints) < 2, None)
        .when(F.size(categories) >= 3, "chaotic")
        .when(F.size(categories) == 2, F.when(first * 2 == F.size(prints), "chaotic").otherwise("mixed"))
        .when(F.size(kinds) == 1, "stable")
        .otherwise("consistent")
    )


def weakest_level(prints: Column) -> Column:
    """The weakest comparison level over all pairs of an array of fingerprints; null for fewer than two."""
    ranks = F.create_map(*[F.lit(x) for i, name in enumerate(("none", "same_category", "same_kind", "exact")) for x in (name, i)])
    names = F.array(*map(F.lit, ("none", "same_category", "same_kind", "exact")))
    least = F.array_min(F.flatten(F.transform(prints, lambda a: F.transform(prints, lambda b: F.element_at(ranks, failures.compare_fingerprints(a, b))))))
    return F.when(F.size(prints) >= 2, F.element_at(names, least + 1))


def required_pages(total: Column) -> Column:
    return F.greatest(F.lit(2), F.floor((total * 2 + 2) / 3))


def _count(results: Column, verdict: str) -> Column:
    return F.size(F.filter(results, lambda r: r == verdict))


def taint(results: Column, verdicts=TAINTS) -> Column:
    """', 1x soft_block' and so on, for the verdicts that occur."""
    parts = F.array(*[F.when(_count(results, v) > 0, F.concat(_count(results, v).cast("string"), F.lit(f"x {v}"))) for v in verdicts])
    said = F.array_join(F.filter(parts, lambda p: p.isNotNull()), ", ")
    return F.when(said == "", "").otherwise(F.concat(F.lit(", "), said))


def page_gate(results: Column, mode: Column) -> Column:
    """struct<passes, reason>: whether the pages seen allow a repair in this mode."""
    real, total, bad = _count(results, "real_page"), F.size(results), _count(results, "anti_bot")
    ratio, dirt = F.concat_ws("/", real.cast("string"), total.cast("string")), taint(results, (*TAINTS, "anti_bot"))
    made = lambda ok, reason: F.struct(F.lit(ok).alias("passes"), reason.alias("reason"))
    return (
        F.when(F.coalesce(total, F.lit(0)) < 1, made(False, F.lit("No page verification results available")))
        .when(bad > 0, made(False, F.format_string("Anti-bot detected in %d/%d attempts — regeneration blocked", bad, total)))
        .when(mode.isin("cautious", "balanced") & (real == total), made(True, F.format_string("Page verified real (%s attempts)", ratio)))
        .when(mode.isin("cautious", "balanced"), made(False, F.format_string("Page not fully verified (%s REAL_PAGE%s) — regeneration blocked in %s mode", ratio, dirt, mode)))
        .when(real >= required_pages(total), made(True, F.format_string("Page verified real (%s attempts, eager mode)", ratio)))
        .otherwise(made(False, F.format_string("Insufficient page verification (%s REAL_PAGE, need %d%s) — regeneration blocked", ratio, required_pages(total), dirt)))
    )


def decide(category: Column, stability: Column, results: Column, mode: Column, eligible: Column) -> Column:
    """struct<action, reason>: regenerate or raise."""
    made = lambda action, reason: F.struct(F.lit(action).alias("action"), reason.alias("reason"))
    real, total, bad = _count(results, "real_page"), F.size(results), _count(results, "anti_bot")
    chain = F.when(category == "A", made("regenerate", F.lit("Parse error (Category A) — code is structurally broken, regenerating immediately")))
    for name, reason in NEVER_REASONS.items():
        chain = chain.when(category == name, made("raise", F.lit(reason)))
    chain = (
        chain.when((category == "E") & ~eligible, made("raise", F.lit("Page state error (Category E) — context/frame destruction is not eligible for regeneration in any mode")))
        .when(stability.isin("mixed", "chaotic"), made("raise", F.format_string("Failure pattern is %s — evidence too noisy to justify regeneration", stability)))
        .when(F.coalesce(total, F.lit(0)) < 1, made("raise", F.lit("No page verification results available")))
        .when(bad > 0, made("raise", F.format_string("Anti-bot detected in %d/%d attempts — regeneration blocked", bad, total)))
        .when(real < required_pages(total), made("raise", F.format_string("Insufficient page verification (%d/%d REAL_PAGE%s) — regeneration blocked", real, total, taint(results))))
        .when(stability.isNull(), made("raise", F.lit("Stability is unknown — defaulting to raise")))
    )
    for (tier, level, whole), modes in REPAIRS.items():
        here = category.isin(*(("B", "G") if tier == 1 else ("D", "E"))) & (stability == level) & ((real == total) if whole else (real < total))
        subject = "Script fault" if tier == 1 else "Timeout/state error"
        seen = "page verified real" if whole else "page mostly verified"
        told = lambda verb, subject=subject, level=level, seen=seen: F.format_string(f"{subject} — {level} failure pattern, {seen} (%d/%d, %s mode): {verb}", real, total, mode)
        if modes:
            chain = chain.when(here & mode.isin(*modes), made("regenerate", told("regenerating")))
        chain = chain.when(here, made("raise", told("stronger evidence required")))
    return chain.otherwise(made("raise", F.lit("Unknown category — defaulting to raise")))


def page_summary(results: Column) -> Column:
    real, total = _count(results, "real_page"), F.size(results)
    chain = F.when(F.coalesce(total, F.lit(0)) < 1, "")
    for verdict, label in (("anti_bot", "Anti-bot"), ("soft_block", "Non-content page"), ("server_error", "Server error")):
        chain = chain.when(_count(results, verdict) > 0, F.format_string(f"{label} detected (%d/%d attempts)", _count(results, verdict), total))
    return chain.when(real == total, F.format_string("Verified real (%d/%d attempts)", real, total)).when(real > 0, F.format_string("Partially verified (%d/%d REAL_PAGE)", real, total)).otherwise(F.format_string("Not verified (0/%d REAL_PAGE)", total))


def message(action: Column, reason: Column, category: Column, stability: Column, results: Column, errors: Column, mode: Column) -> Column:
    """The report of a diagnosis, several lines."""
    labels = F.create_map(*[F.lit(x) for pair in CATEGORY_LABELS.items() for x in pair])
    label = F.coalesce(F.try_element_at(labels, category), F.concat(F.lit("Unknown ("), category, F.lit(")")))
    n = F.size(errors).cast("string")
    summary = F.try_element_at(F.filter(F.transform(errors, failures.error_summary), lambda e: e.isNotNull()), F.lit(1))
    later = "  Try again later, or force regeneration: scraper.run(regenerate=True)"
    lines = lambda *x: F.lit("\n".join(x))
    why = (
        F.when(_count(results, "anti_bot") > 0, lines("  Auto-fix will not regenerate — the page served is not real content.", "  A new script would face the same anti-bot system.", "", "  Try again later, or use a different IP/proxy."))
        .when(_count(results, "soft_block") > 0, lines("  Auto-fix will not regenerate — the page appears to be a non-content page (login, maintenance, or rate-limit), not real site content.", "  A new script would encounter the same page.", "", "  Check the URL manually, or try from a different network/session."))
        .when(_count(results, "server_error") > 0, lines("  Auto-fix will not regenerate — the server returned errors during diagnosis.", "  The failure may be caused by server issues, not a broken script.", "", later))
        .when(stability.isin("mixed", "chaotic"), lines("  The failure pattern is inconsistent — likely an environmental issue.", "  Auto-fix will not regenerate.", "", later))
        .when((mode == "cautious") & category.isin("D", "E"), F.concat(F.format_string("  Mode: %s — auto-fix does not regenerate %s errors.\n", mode, F.lower(label)), lines("  To regenerate: scraper.run(regenerate=True)", '  To enable: auto_regenerate="balanced" or auto_regenerate="eager"')))
        .otherwise(F.concat(F.lit("  Auto-fix will not regenerate — "), reason, F.lit("\n\n" + later)))
    )
    seen = page_summary(results)
    return F.concat_ws(
        "\n",
        F.lit("Cached script failed.\n"),
        F.concat(F.lit("  Category: "), label),
        F.concat(F.lit("  Error:    "), summary),
        F.concat(F.lit("  Attempts: "), n, F.lit("/"), n, F.lit(" failed"), F.coalesce(F.concat(F.lit(" ("), stability, F.lit(" pattern)")), F.lit(""))),
        F.when(seen != "", F.concat(F.lit("  Page:     "), seen)),
        F.lit(""),
        F.when(action == "regenerate", F.concat(F.lit("  Auto-fix is regenerating the script ("), mode, F.lit(" mode).\n  Reason: "), reason)).otherwise(why),
    )


def diagnose(attempts: DataFrame) -> DataFrame:
    """One row per run_id: succeeded, or else action, category, stability, page_results, e_eligible, reason, message.

    Attempts after the third, and after the one that ends a run early (a success; A, F2 or F3 at first; A or F3 later),
    don't count. The category is the first attempt's unless a later A or F3 ended the run; stability is that of
    attempts which saw the real page."""
    seen = examined(attempts.where(F.col("attempt_no").between(1, MAX_ATTEMPTS)))
    row = F.struct("attempt_no", "success", "category", "fingerprint", "page_result", "error")
    runs = seen.groupBy("run_id").agg(F.sort_array(F.collect_list(row)).alias("all"), F.first("mode", ignorenulls=True).alias("mode"))
    last = F.transform("all", lambda a, i: F.when(a["success"] | a["category"].isin("A", "F3") | ((i == 0) & (a["category"] == "F2")), i + 1))
    runs = runs.withColumn("end", F.coalesce(F.array_min(last), F.size("all"))).withColumn("kept", F.slice("all", F.lit(1), F.col("end"))).withColumn("final", F.element_at("kept", -1))
    runs = runs.withColumn("succeeded", F.col("final.success"))
    early = F.coalesce(F.array_min(last).isNotNull(), F.lit(False))
    category = F.when(early, F.col("final.category")).otherwise(F.element_at("kept", 1)["category"])
    real = F.transform(F.filter("kept", lambda a: a["page_result"] == "real_page"), lambda a: a["fingerprint"])
    gone = F.exists("kept", lambda a: (a["category"] == "E") & (a["error"].contains(failures.NEVER_REPAIRED[0]) | a["error"].contains(failures.NEVER_REPAIRED[1])))
    runs = runs.select(
        "run_id", "mode", "succeeded", F.size("kept").alias("n_attempts"), category.alias("category"), F.when(~early, stability_of(real)).alias("stability"),
        F.transform("kept", lambda a: a["page_result"]).alias("page_results"), (~F.coalesce(gone, F.lit(False))).alias("e_eligible"),
        F.transform("kept", lambda a: F.coalesce(strip(a["error"]), F.lit(""))).alias("errors"),
    )
    told = runs.withColumn("d", decide(*[F.col(c) for c in ("category", "stability", "page_results", "mode", "e_eligible")]))
    told = told.select("*", F.col("d.action").alias("action"), F.col("d.reason").alias("reason"))
    said = message(*[F.col(c) for c in ("action", "reason", "category", "stability", "page_results", "errors", "mode")])
    failed = lambda c: F.when(~F.col("succeeded"), c)
    return told.select(
        "run_id", "mode", "succeeded", "n_attempts", *[failed(F.col(c)).alias(c) for c in ("category", "stability", "page_results", "e_eligible", "action", "reason")],
        failed(failures.exception_name(F.col("category"))).alias("exception"), failed(said).alias("message"),
    )
