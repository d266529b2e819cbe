"""Stable identifiers and canonical hashes as Columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Name lengths of the result store.
RUN_ID_LENGTH = 72
ARTIFACT_NAME_LIMIT = 128
ARTIFACT_SUFFIX_RESERVE = 24
RUN_PREFIX = "run-"
SAMPLE_PREFIX = "samples/"

# Fixed value: shape of an owner/name repository id.
REPO_ID_PATTERN = r"^[^/\s]+/[^/\s]+$"


def quoted(text: Column) -> Column:
    """A JSON string literal; non-ASCII characters stay as they are."""
    return F.regexp_extract(F.to_json(F.array(text)), r"(?s)^\[(.*)\]$", 1)


def stable_uuid(*parts: Column) -> Column:
    """A version-4 shaped UUID from the sha256 of the NUL-joined parts."""
    digest = F.sha2(F.concat_ws("\0", *parts), 256)
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(
        F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 4), F.lit("-4"), F.substring(digest, 14, 3),
        F.lit("-"), variant, F.substring(digest, 18, 3), F.lit("-"), F.substring(digest, 21, 12),
    )


def shorten(text: Column, limit: Column) -> Column:
    """Text cut to `limit` characters, ending in a hash of the whole text so that cuts do not collide."""
    kept = F.regexp_replace(F.left(text, limit - 11), r"[-_/]+$", "")
    return F.when(F.length(text) <= limit, text).otherwise(
        F.concat(kept, F.lit("-"), F.left(F.sha1(text), F.lit(10)))
    )


def run_id(model: Column, suffix: str = "-001") -> Column:
    return shorten(F.concat(model, F.lit(suffix)), F.lit(RUN_ID_LENGTH))


def sample_table_key(run: Column, task: Column) -> Column:
    """Key of a task's sample table, short enough for the names generated from it."""
    budget = F.lit(
        ARTIFACT_NAME_LIMIT - ARTIFACT_SUFFIX_RESERVE - len(RUN_PREFIX) - 1 - len(SAMPLE_PREFIX)
    ) - F.length(run)
    return F.concat(F.lit(SAMPLE_PREFIX), shorten(task, budget))


def result_id(task: Column, key: Column, score: Column) -> Column:
    """Row id of an exported score; the score enters with 17 significant digits."""
    return F.sha2(F.concat_ws("\0", task, key, F.format_string("%.17g", score)), 256)


def sample_hash(prompt: Column, target: Column) -> Column:
    """sha256 of the canonical JSON of prompt and reference."""
    return F.sha2(
        F.concat(F.lit('{"raw": '), quoted(prompt), F.lit(', "reference": '), quoted(target), F.lit("}")), 256
    )


def sample_priority(evaluation_name: Column, filter_name: Column, hash_: Column, sample_id: Column) -> Column:
    """Hex sha256 over the sample's identity; hex order is the order of the hash as a number."""
    return F.sha2(
        F.concat(
            F.lit('{"evaluation_name": '), quoted(evaluation_name), F.lit(', "filter": '), quoted(filter_name),
            F.lit(', "sample_hash": '), quoted(hash_), F.lit(', "sample_id": '), quoted(sample_id), F.lit("}"),
        ),
        256,
    )


def run_signature(settings: Column) -> Column:
    """sha256 over the settings map in key order."""
    entries = F.array_sort(F.map_entries(settings))
    body = F.array_join(
        F.transform(entries, lambda e: F.concat(quoted(e["key"]), F.lit(":"), quoted(e["value"]))), ","
    )
    return F.sha2(F.concat(F.lit('{"configuration":{'), body, F.lit('},"schema_version":1}')), 256)


def is_repo_id(text: Column) -> Column:
    return F.coalesce(text.rlike(REPO_ID_PATTERN) & ~F.startswith(text, F.lit(".")), F.lit(False))


def first_repo_id(*candidates: Column) -> Column:
    """The first candidate shaped owner/name."""
    return F.coalesce(*[F.when(is_repo_id(c), c) for c in candidates])


def package_version(environment: Column, package: str) -> Column:
    """Version of an installed package from an environment listing."""
    pattern = rf"(?im)^\[(?:pip3|conda)\]\s+\Q{package}\E(?:==|\s+)([^\s]+)"
    return F.nullif(F.regexp_extract(environment, pattern, 1), F.lit(""))


def evaluation_name(composite: Column, family: Column, benchmark: Column, split: Column) -> Column:
    """[composite.]family.benchmark.split; NULL when a part is empty or holds a dot."""
    clean = lambda c: F.nullif(F.trim(c), F.lit(""))
    parts = [F.coalesce(clean(family), clean(benchmark)), clean(benchmark), F.coalesce(clean(split), F.lit("overall"))]
    usable = F.lit(True)
    for part in [F.coalesce(clean(composite), F.lit("-")), *parts]:
        usable = usable & part.isNotNull() & ~F.contains(part, F.lit("."))
    return F.when(usable, F.concat_ws(".", clean(composite), *parts))


def has_name_scheme(name: Column) -> Column:
    return F.coalesce(name.rlike(r"^[^.]+(\.[^.]+){2,3}$"), F.lit(False))
