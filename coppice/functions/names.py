"""Predicates on file names: entry points, configuration, tests, secrets, binary."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from coppice.functions.paths import basename, ext, stem

# Extensions never read as text.
BINARY_EXTS = [
    ".png", ".jpg", ".jpeg", ".gif", ".bmp", ".ico", ".webp", ".mp3", ".mp4", ".mov", ".avi", ".wav", ".flac",
    ".ogg", ".webm", ".mkv", ".zip", ".tar", ".gz", ".rar", ".7z", ".bz2", ".xz", ".pdf", ".doc", ".docx",
    ".xls", ".xlsx", ".ppt", ".pptx", ".exe", ".dll", ".so", ".dylib", ".bin", ".o", ".a", ".class", ".jar",
    ".woff", ".woff2", ".ttf", ".otf", ".eot", ".db", ".sqlite", ".sqlite3", ".pyc", ".pyo", ".whl",
]

# Names, in lower case, where a program starts.
ENTRY_NAMES = [
    "main.py", "__main__.py", "app.py", "server.py", "manage.py", "wsgi.py", "asgi.py", "index.js",
    "index.ts", "index.mjs", "index.cjs", "main.js", "main.ts", "server.js", "server.ts", "app.js", "app.ts",
    "main.go", "main.rs", "makefile", "dockerfile", "docker-compose.yml", "docker-compose.yaml",
]

# Names, in lower case, of configuration files.
CONFIG_NAMES = [
    ".env", ".env.local", ".env.example", ".env.development", ".env.production", "tsconfig.json",
    "jsconfig.json", "babel.config.js", ".babelrc", "webpack.config.js", "vite.config.js", "vite.config.ts",
    "rollup.config.js", "eslint.config.js", ".eslintrc", ".eslintrc.json", ".eslintrc.js", ".prettierrc",
    "pyproject.toml", "setup.py", "setup.cfg", "requirements.txt", "pipfile", "cargo.toml", "go.mod",
    "go.sum", "dockerfile", "docker-compose.yml", "docker-compose.yaml", ".gitignore", ".gitattributes",
    "tox.ini", "pytest.ini", "jest.config.js", "jest.config.ts", "next.config.js", "next.config.ts",
    "nuxt.config.js", "svelte.config.js", "tailwind.config.js", "tailwind.config.ts", "postcss.config.js",
    ".npmrc", ".nvmrc", ".python-version", ".ruby-version", "makefile", "cmakelists.txt",
]

# Extensions whose tests are found by name.
TESTED_EXTS = [".py", ".js", ".jsx", ".ts", ".tsx", ".go"]

# Names and endings that may hold credentials.
SECRET_EXTS = [".pem", ".key", ".p12", ".pfx", ".keystore", ".jks"]
SECRET_NAMES = [
    "credentials.json",
    "service-account.json",
    ".npmrc",
    ".pypirc",
    ".netrc",
    ".htpasswd",
]


def is_binary_name(name: Column) -> Column:
    return ext(name).isin(BINARY_EXTS)


def is_entry_name(name: Column) -> Column:
    return F.lower(name).isin(ENTRY_NAMES)


def is_config_name(name: Column) -> Column:
    return F.lower(name).isin(CONFIG_NAMES)


def is_test_name(name: Column) -> Column:
    """Named like a test: ``test_x``, ``x_test``, ``x.test``, ``x.spec``."""
    return stem(F.lower(name)).rlike(r"(?s)\Atest_|(_test|\.test|\.spec)\z")


def is_test_path(path: Column) -> Column:
    """Named like a test, or kept in a test directory."""
    return is_test_name(basename(path)) | path.rlike(r"\Atests?/|/tests?/|/__tests__/")


def tests_apply(name: Column) -> Column:
    """Whether asking for a test makes sense for this kind of file."""
    return ext(name).isin(TESTED_EXTS + [".rs"])


def is_sensitive_name(name: Column) -> Column:
    """Names that should not be pasted into a chat or a ticket."""
    low = F.lower(name)
    env = (low == ".env") | (
        F.startswith(low, F.lit(".env."))
        & ~F.contains(low, F.lit("example"))
        & ~F.contains(low, F.lit("sample"))
    )
    return (
        env
        | ext(name).isin(SECRET_EXTS)
        | low.rlike(r"\Aid_(rsa|ed25519|ecdsa)")
        | low.isin(SECRET_NAMES)
        | F.contains(low, F.lit("secret"))
    )
