"""Fixed summaries of JSON answers of code hosts and package registries; null lines vanish."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import focus
from .markdown import readme


def _s(body: Column, path: str) -> Column:
    return F.nullif(F.get_json_object(body, f"$.{path}"), F.lit(""))


def _or(x: Column, other: str = "?") -> Column:
    return F.coalesce(x, F.lit(other))


def day(x: Column) -> Column:
    return F.substring(x, 1, 10)


def _line(head: str, *parts: Column) -> Column:
    return F.concat(F.lit(head), *parts)


def repository(repo: Column, release: Column, looked_up: Column | None = None) -> Column:
    """Summary of a repository; release is its latest release or newest tag, and no line tells of it unless looked_up."""
    topics = F.slice(F.from_json(F.get_json_object(repo, "$.topics"), "array<string>"), 1, 8)
    tag, at = _s(release, "tag_name"), _s(release, "published_at")
    newest = F.when(tag.isNull(), F.lit("Latest release: none")).when(at.isNull(), _line("Latest tag: ", tag)).otherwise(_line("Latest release: ", tag, F.lit(" ("), day(at), F.lit(")")))
    return F.concat_ws(
        "\n",
        _line("# ", _or(_s(repo, "full_name"))),
        _s(repo, "description"),
        _line("Stars: ", _or(_s(repo, "stargazers_count")), F.lit(" · Forks: "), _or(_s(repo, "forks_count")), F.lit(" · Open issues: "), _or(_s(repo, "open_issues_count"))),
        _line(
            "License: ", _or(F.nullif(_s(repo, "license.spdx_id"), F.lit("NOASSERTION")), "none"), F.lit(" · Default branch: "), _or(_s(repo, "default_branch")),
            F.lit(" · Last push: "), _or(day(_s(repo, "pushed_at"))),
        ),
        newest if looked_up is None else F.when(looked_up, newest),
        _line("Homepage: ", _s(repo, "homepage")),
        F.when(F.size(topics) > 0, _line("Topics: ", F.array_join(topics, ", "))),
        _line("URL: ", _s(repo, "html_url")),
    )


def crate(body: Column) -> Column:
    c = lambda name: _s(body, f"crate.{name}")
    return F.concat_ws(
        "\n",
        _line("# ", _or(c("name")), F.lit(" "), _or(F.coalesce(c("max_stable_version"), c("max_version")))),
        c("description"),
        _line("Updated: ", _or(day(c("updated_at"))), F.lit(" · Downloads: "), _or(c("downloads")), F.lit(" total, "), _or(c("recent_downloads")), F.lit(" last 90 days")),
        _line("Registry: https://crates.io/crates/", c("name")),
        _line("Repository: ", c("repository")),
        _line("Docs: ", F.coalesce(c("documentation"), _line("https://docs.rs/", c("name")))),
    )


def npm(body: Column, date: Column) -> Column:
    """Summary of a manifest; date is the publish date that npm_date found."""
    text = lambda path: F.when(~F.coalesce(_s(body, path), F.lit("")).startswith("{"), _s(body, path))
    link = F.coalesce(text("repository"), _s(body, "repository.url"))
    return F.concat_ws(
        "\n",
        _line("# ", _or(_s(body, "name")), F.lit(" "), _or(_s(body, "version"))),
        _s(body, "description"),
        _line("Published: ", _or(day(date)), F.lit(" · License: "), _or(F.coalesce(text("license"), _s(body, "license.type")))),
        _line("Registry: https://www.npmjs.com/package/", _s(body, "name")),
        _line("Repository: ", F.regexp_replace(F.regexp_replace(link, r"^git\+", ""), r"\.git$", "")),
        _line("Homepage: ", _s(body, "homepage")),
    )


def npm_date(body: Column, found: Column) -> Column:
    """The publish date in a search answer, only if its first package is this name and version."""
    p = lambda name: F.get_json_object(found, f"$.objects[0].package.{name}")
    return F.when((p("name") == F.get_json_object(body, "$.name")) & (p("version") == F.get_json_object(body, "$.version")), p("date"))


def pypi(body: Column) -> Column:
    urls = F.map_entries(F.from_json(F.get_json_object(body, "$.info.project_urls"), "map<string,string>"))
    urls = F.slice(F.filter(urls, lambda e: e["value"].isNotNull() & F.lower(e["key"]).rlike("home|source|repo|code")), 1, 3)
    files = F.from_json(F.get_json_object(body, "$.releases"), "map<string,array<struct<upload_time:string>>>")
    uploaded = F.nullif(F.get(F.try_element_at(files, _or(_s(body, "info.version"))), F.lit(0))["upload_time"], F.lit(""))
    return F.concat_ws(
        "\n",
        _line("# ", _or(_s(body, "info.name")), F.lit(" "), _or(_s(body, "info.version"))),
        _s(body, "info.summary"),
        _line("Released: ", _or(day(uploaded)), F.lit(" · Requires Python: "), _or(_s(body, "info.requires_python"), "any")),
        _line("Registry: https://pypi.org/project/", _s(body, "info.name"), F.lit("/")),
        F.nullif(F.array_join(F.transform(urls, lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n"), F.lit("")),
    )


def http_error(service: Column, status: Column, quota_gone: Column, body: Column) -> Column:
    """The error text of a code host or registry; limits are known of the code host alone."""
    host = service == "GitHub"
    spent = F.coalesce(quota_gone, F.lit(False)) | F.contains(F.lower(F.coalesce(body, F.lit(""))), F.lit("rate limit"))
    return (
        F.when(status == 404, _line("not found on ", service))
        .when((status == 429) & host, F.lit("rate limited (secondary limit); set GITHUB_TOKEN"))
        .when((status == 403) & host & spent, F.lit("rate limited; set GITHUB_TOKEN"))
        .when((status == 403) & host, F.lit("access denied (403)"))
        .otherwise(F.concat(service, F.lit(" returned HTTP "), status.cast("string")))
    )


def answer(service: Column, status: Column, quota_gone: Column, body: Column, url: Column) -> Column:
    """struct(body, error): a successful answer that is JSON, or what was wrong with it."""
    good = status.between(200, 299)
    parsed = good & F.try_parse_json(body).isNotNull()
    return F.struct(
        F.when(parsed, body).alias("body"),
        F.when(~good, http_error(service, status, quota_gone, body)).when(~parsed, _line("invalid JSON from ", url)).alias("error"),
    )


def newest(release: Column, tags: Column) -> Column:
    """The latest release, else the newest tag in the same form; null if there is neither."""
    name = F.get_json_object(tags, "$[0].name")
    return F.coalesce(F.when(F.try_parse_json(release).isNotNull(), release), F.when(name.isNotNull(), F.to_json(F.struct(name.alias("tag_name")))))


def summaries(rows: DataFrame, terms: list[str], max_chars: int, service: str = "GitHub") -> DataFrame:
    """spec, text, error of recorded answers: repository, latest release or newest tag, README excerpt.

    rows has spec and repo, rel, tags and readme with their statuses.  Only the repository's answer decides; a failed
    release lookup drops its line, a failed README is told in place.
    """
    svc = F.lit(service)
    url = F.concat(F.lit("https://api.github.com/repos/"), F.col("spec"))
    d = rows.withColumn("_a", answer(svc, F.col("repo_status"), F.lit(False), F.col("repo"), url))
    release = F.when(F.col("rel_status").between(200, 299), F.col("rel"))
    tags = F.when(F.col("tag_status").between(200, 299), F.col("tags"))
    looked_up = release.isNotNull() | tags.isNotNull()
    d = d.withColumn("_head", repository(F.col("_a.body"), newest(release, tags), looked_up))
    d = d.withColumn("_readme", F.when(F.col("readme_status").between(200, 299), readme(F.col("readme"))))
    d = focus.view(d, "_readme", T.paragraphs(F.coalesce("_readme", F.lit(""))), terms, 5)
    cut = T.truncate(F.col("focused"), max_chars)
    whole = F.length(cut) == F.length("focused")
    body = F.when(whole, F.col("focused")).otherwise(T.close_fence(cut))
    body = F.when(F.col("missed"), F.concat(body, F.lit(f"\n\n{focus.MISS}"))).otherwise(body)
    excerpt = F.concat(F.lit("## README (excerpt)\n"), F.rtrim(body), F.when(whole, F.lit("")).otherwise(F.lit("\n\n<!-- readme truncated -->")))
    missing = F.concat(F.lit("<!-- readme unavailable: "), http_error(svc, F.col("readme_status"), F.lit(False), F.col("readme")), F.lit(" -->"))
    text = F.concat(F.col("_head"), F.lit("\n\n"), F.when(F.col("_readme").isNotNull(), excerpt).otherwise(missing))
    return d.select(*rows.columns, F.when(F.col("_a.error").isNull(), text).alias("text"), F.col("_a.error").alias("error"))
