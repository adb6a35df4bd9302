"""Which files of a tree are read: predicates in their fixed order, as one skip reason."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.languages import suffix_language
from plumbline.functions.text import base_name

# Fixed values.
IGNORED_DIRS = [
    ".git", ".hg", ".svn", ".bzr", ".cache", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".parcel-cache", "__pycache__", ".turbo",
    ".gradle", ".tox", ".nox", ".venv", "venv", ".next", ".nuxt", ".svelte-kit", "bower_components", "node_modules", "build", "dist",
    "out", "target", "coverage", "htmlcov", "deriveddata", "pods", ".plumbline",
]
IGNORED_FILES = [".coverage", ".ds_store", "desktop.ini", "npm-debug.log", "thumbs.db", "yarn-error.log"]
IGNORED_SUFFIXES = [".a", ".class", ".dll", ".dylib", ".exe", ".lib", ".min.css", ".min.js", ".o", ".obj", ".pyc", ".pyo", ".so"]
ENV_TEMPLATES = [".env.defaults", ".env.dist", ".env.example", ".env.sample", ".env.template"]
SENSITIVE_NAMES = [
    ".dockercfg", ".htpasswd", ".netrc", ".npmrc", ".pypirc", "auth.json", "credentials", "credentials.json", "id_dsa", "id_ecdsa",
    "id_ed25519", "id_rsa", "kubeconfig", "secrets", "secrets.json", "secrets.toml", "secrets.yaml", "secrets.yml",
]
SENSITIVE_SUFFIXES = [".jks", ".kdbx", ".key", ".keystore", ".p12", ".pem", ".pfx", ".pkcs12", ".tfstate"]
CONFIG_FILE_NAMES = [
    ".editorconfig", ".gitattributes", ".gitignore", ".npmignore", ".prettierignore", ".prettierrc", ".python-version",
    "cmakelists.txt", "dockerfile", "gemfile", "go.mod", "go.sum", "justfile", "makefile", "package.json", "pipfile", "procfile",
    "pyproject.toml", "requirements.txt", "rust-toolchain", "rust-toolchain.toml", "workspace",
]
MARKDOWN_STEMS = [
    "authors", "changelog", "code_of_conduct", "contributing", "history", "license", "notice", "readme", "security",
]
MARKER = r"(?i)<!--[ \t]*generator:[ \t]*plumbline[^>]*deterministic[ \t]+(source[ \t]+map|static[ \t]+graph)\.[ \t]*-->"
#: Forms of credentials that count with high confidence; plain enough for every regular-expression engine.
HIGH_CONFIDENCE = r"-----BEGIN [A-Z ]*PRIVATE KEY-----|\b(AKIA|ASIA)[A-Z0-9]{16}\b|\bghp_[A-Za-z0-9]{30,}|\bgithub_pat_[A-Za-z0-9_]{30,}|\bglpat-[A-Za-z0-9_-]{18,}|\bxox[abprs]-[A-Za-z0-9-]{10,}|\bAIza[A-Za-z0-9_-]{30,}|\bsk-[A-Za-z0-9_-]{20,}|\bhf_[A-Za-z0-9]{30,}|\bsk_live_[A-Za-z0-9]{16,}|\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{10,}"
TOKEN_FORMS = HIGH_CONFIDENCE.split("|", 1)[1]


def any_suffix(name: Column, suffixes: list[str]) -> Column:
    hit = F.lit(False)
    for s in suffixes:
        hit = hit | name.endswith(s)
    return hit


def default_ignored(path: Column) -> Column:
    """A component (also the file's own name), name or suffix that is never indexed, ignoring case."""
    low = F.lower(path)
    name = base_name(low)
    return F.exists(F.split(low, "/"), lambda p: p.isin(*IGNORED_DIRS)) | name.isin(*IGNORED_FILES) | any_suffix(name, IGNORED_SUFFIXES)


def sensitive_path(path: Column) -> Column:
    """A name that usually holds credentials."""
    low = F.lower(path)
    name = base_name(low)
    env = ((name == ".env") | name.startswith(".env.")) & ~name.isin(*ENV_TEMPLATES)
    ssh = F.array_contains(F.split(low, "/"), ".ssh") & ~name.endswith(".pub")
    aws = low.rlike(r"(^|/)\.aws/credentials$")
    account = name.rlike(r"^(service[-_]?account.*|.*credentials?.*)\.json$")
    return env | name.isin(*SENSITIVE_NAMES) | any_suffix(name, SENSITIVE_SUFFIXES) | ssh | aws | account


def detect_language(path: Column) -> Column:
    """Language by suffix, then by the names of configuration and documentation files; null if unsupported."""
    name = F.lower(base_name(path))
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    config = name.isin(*CONFIG_FILE_NAMES, *ENV_TEMPLATES) | name.rlike(r"^requirements.*\.txt$")
    return F.coalesce(suffix_language(path), F.when(config, "config"), F.when(name.isin(*MARKDOWN_STEMS) | stem.isin(*MARKDOWN_STEMS), "markdown"))


def control_ratio(text: Column) -> Column:
    """Share of control characters, but for backspace, tab, line feed, form feed and carriage return; 0 for empty texts."""
    n = F.length(text)
    controls = n - F.length(F.regexp_replace(text, r"[\x00-\x07\x0b\x0e-\x1f\x7f]", ""))
    return F.when(n == 0, F.lit(0.0)).otherwise(controls / n)


def is_binary(text: Column) -> Column:
    return (control_ratio(text) > 0.02) | (F.instr(text, "\x00") > 0)


def generated_document(text: Column) -> Column:
    """Whether this engine's own marker stands in the first 16 lines."""
    head = F.array_join(F.slice(F.split(F.substring(text, 1, 4096), "\n"), 1, 16), "\n")
    return head.rlike(MARKER)


def likely_secret(text: Column) -> Column:
    return text.rlike(HIGH_CONFIDENCE)


def redact_tokens(text: Column) -> Column:
    """Token forms replaced; what else is there stays."""
    return F.regexp_replace(text, TOKEN_FORMS, "[REDACTED]")


def skip_reason(path: Column, size: Column, text: Column, max_bytes: int) -> Column:
    """The first reason in the fixed order for which a file is not indexed; null if it is."""
    return (
        F.when(default_ignored(path), "default_ignored")
        .when(sensitive_path(path), "sensitive_filename")
        .when(detect_language(path).isNull(), "unsupported")
        .when(size > max_bytes, "oversize")
        .when(text.isNull(), "unreadable")
        .when(is_binary(text), "binary")
        .when(generated_document(text), "generated")
        .when(likely_secret(text), "likely_secret")
    )
