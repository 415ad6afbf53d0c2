"""Command registry: category, typical saving and interactive subcommands of known tools."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logcompact.functions.profiles import PROFILE_OF

# Category | command names | typical saving in percent | interactive subcommands.
_REGISTRY = """
Git | git yadm | 70
GitHub CLI | gh | 60
GitLab CLI | glab | 60
Graphite | gt | 55
Cargo | cargo | 80 | run
Rust | rustc | 60
Go | go | 75 | run
Go | golangci-lint | 65
Go | gofmt goimports staticcheck | 50
npm | npm | 55 | start, run dev, run watch, run serve
npm | npx | 50
pnpm | pnpm | 55 | start, dev, watch
Yarn | yarn | 55 | start, dev
Bun | bun | 55 | run dev, run start, run watch
TypeScript | tsc | 70
Jest | jest | 85
Vitest | vitest | 85
Prettier | prettier | 60
ESLint | eslint | 65
Biome | biome | 65
OXC | oxc oxlint | 65
Next.js | next | 60
Playwright | playwright | 70
Cypress | cypress | 70
Node.js | node | 40
Deno | deno | 55
pytest | pytest | 80
Python | python python3 | 50 | -c, -i, -m
Python | mypy | 65
Python | ruff | 60
Python | flake8 pylint pyright | 60
Python | pip pip3 | 45
Poetry | poetry | 50 | shell, run
uv | uv | 50 | run
PDM | pdm | 50
Ruby | rake | 70
Ruby | rspec | 80
Ruby | rubocop | 65
Bundler | bundle | 50 | exec, open
Ruby | ruby | 40
RubyGems | gem | 45
.NET | dotnet | 65 | run, watch
Gradle | gradle gradlew ./gradlew | 70
Maven | mvn mvnw ./mvnw | 70
Java | java | 40
Kotlin | kotlin | 40
Swift | swift | 60 | run
Xcode | xcodebuild | 75
PHP | composer | 50 | shell
PHP | php | 40
PHP | phpunit | 75
PHP | phpstan psalm | 60
Files | cat bat | 30
Files | head tail | 30
Files | grep rg ag ack | 50
Files | ls | 90
Files | find fd | 78
Files | tree | 50
Files | diff | 30
Files | wc | 20
Make | make | 55
CMake | cmake | 55
Ninja | ninja | 50
Bazel | bazel bazelisk | 65
Meson | meson | 55
Docker | docker | 65 | exec, run, attach, shell
Docker Compose | docker-compose | 60 | run, exec, up, logs -f
Podman | podman | 65 | exec, run
Kubernetes | kubectl | 70 | exec, port-forward, proxy
Helm | helm | 60
Kubernetes | kustomize | 55
AWS | aws | 55
GCP | gcloud | 55
Azure | az | 55
Terraform | terraform tofu | 60
Ansible | ansible ansible-playbook | 60
Pulumi | pulumi | 55
PostgreSQL | psql | 50
MySQL | mysql mariadb | 50
SQLite | sqlite3 | 50
Prisma | prisma | 65
Database | flyway liquibase | 60
Homebrew | brew | 45
APT | apt apt-get | 50
DNF/YUM | dnf yum | 50
Network | curl | 40
Network | wget | 40
System | ps | 50
System | df du | 55
System | systemctl | 50
System | journalctl | 60
System | lsof netstat ss | 55
Lint | shellcheck | 60
Lint | yamllint | 60
Lint | hadolint | 65
Lint | markdownlint | 55
Lint | pre-commit | 60
Security | semgrep | 65
Elixir | mix | 65 | phx.server, iex
Quarto | quarto | 55
PlatformIO | pio | 60
Nx | nx | 65
Turborepo | turbo | 60
Lerna | lerna | 55
"""


def registry_rows() -> list[tuple[str, str, list[str], float]]:
    """(base, category, interactive, savings_pct), one row per command name."""
    rows = []
    for entry in _REGISTRY.strip().splitlines():
        category, names, pct, *rest = (part.strip() for part in entry.split("|"))
        interactive = [p.strip() for p in rest[0].split(",")] if rest else []
        rows += [(name, category, interactive, float(pct)) for name in names.split()]
    return rows


def _sql(text: str) -> str:
    """A string literal. Rows as literals are a relation of known size, without Python behind it."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def registry_table(spark: SparkSession) -> DataFrame:
    """The registry as a table; its size is fixed, so joins broadcast it."""
    rows = [
        f"({_sql(base)}, {_sql(category)}, CAST(array({', '.join(map(_sql, interactive))}) AS ARRAY<STRING>), {pct}D)"
        for base, category, interactive, pct in registry_rows()
    ]
    return spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS t(base, category, interactive, savings_pct)")


def profile_map(spark: SparkSession) -> DataFrame:
    """Command as typed -> profile name; its size is fixed, so joins broadcast it."""
    rows = [f"({_sql(command)}, {_sql(profile)})" for command, profile in PROFILE_OF.items()]
    return spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS t(command, profile)")


def attach_profile(runs: DataFrame) -> DataFrame:
    """Add the tool profile of each run; unknown commands get null."""
    return runs.join(F.broadcast(profile_map(runs.sparkSession)), "command", "left")
