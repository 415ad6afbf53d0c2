"""Per-tool tests that tell noise, success and error lines apart, stated as data.

A profile has three roles. A role lists alternatives; an alternative is one test or a group of
tests that must all hold. One builder turns each role of all profiles into a single literal regular
expression over "profile NUL text", which a task compiles once: written out as one string function
per test, the 19 profiles would outgrow a generated method and lose code generation.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from logcompact.functions.dialect import any_of, to_java
from logcompact.functions.text import WHITE_SPACE, trim_space


@dataclass(frozen=True)
class Test:
    op: str
    value: str = ""
    negate: bool = False

    def __invert__(self) -> Test:
        return Test(self.op, self.value, not self.negate)

    def regex(self) -> str | None:
        """The test as an expression from the start of the text, or None if there is none."""
        literal = "".join(c if c.isalnum() or c in "_ " else re.escape(c) for c in self.value)
        return {
            "prefix": literal,
            "suffix": f"(?s:.*){literal}\\z",
            "contains": f"(?s:.*?){literal}",
            "equals": f"{literal}\\z",
            "regex": self.value.removeprefix("^"),
            "blank": f"[{WHITE_SPACE}]*\\z",
        }.get(self.op)


def prefix(*values: str) -> tuple[Test, ...]:
    return tuple(Test("prefix", v) for v in values)


def suffix(*values: str) -> tuple[Test, ...]:
    return tuple(Test("suffix", v) for v in values)


def contains(*values: str) -> tuple[Test, ...]:
    return tuple(Test("contains", v) for v in values)


def equals(*values: str) -> tuple[Test, ...]:
    return tuple(Test("equals", v) for v in values)


def regex(*values: str) -> tuple[Test, ...]:
    return tuple(Test("regex", v) for v in values)


def both(*tests: tuple[Test, ...]) -> tuple[tuple[Test, ...], ...]:
    """One alternative that needs every test."""
    return (sum(tests, ()),)


def lacks(*values: str) -> tuple[Test, ...]:
    return tuple(~t for t in contains(*values))


Role = tuple


@dataclass(frozen=True)
class Profile:
    """``None`` for success or error means the general tests; for noise, no noise at all."""

    commands: tuple[str, ...]
    noise: Role | None = None
    success: Role | None = None
    error: Role | None = None
    trimmed: tuple[str, ...] = ()


# The general tests.
GENERAL_ERROR = contains(
    "error:", "ERROR:", "error[", "FAILED", "FAILURE", "Exception", "exception",
    "panic:", "PANIC", "fatal:", "FATAL", "Traceback (most recent call last)",
    "ASSERTION FAILED", "AssertionError", "undefined:", "cannot find module",
    "permission denied", "segmentation fault", "SIGSEGV", "SIGABRT",
) + both(prefix("goroutine "), contains(" ["))

GENERAL_SUCCESS = contains(
    "--- PASS:", "PASS\t", " passed", "all tests passed", "Build succeeded", "BUILD SUCCESS",
    "✓ ", "✔ ", "Done ",
)

# The tool profiles.
PROFILES: dict[str, Profile] = {
    "go": Profile(
        commands=("go",),
        noise=prefix("=== RUN", "=== CONT", "=== PAUSE"),
        success=prefix("--- PASS:", "    --- PASS:", "ok  \t", "ok \t", "?   \t", "? \t"),
        error=prefix(
            "--- FAIL:", "    --- FAIL:", "FAIL\t", "FAIL ", "panic:", "goroutine ",
            "runtime error:", "build failed",
        ) + equals("FAIL"),
    ),
    "cargo": Profile(
        commands=("cargo",),
        noise=prefix("Compiling ", "Checking ", "Downloading ", "Updating ", "Fetching ", "Blocking ")
        + equals(".", ""),
        success=prefix("Finished ", "test result: ok.") + both(prefix("test "), contains(" ... ok")),
        error=prefix("error[", "error:", "FAILED", "thread '", "note: run with")
        + both(prefix("test "), contains(" ... FAILED")),
        trimmed=("noise", "success", "error"),
    ),
    "pytest": Profile(
        commands=("pytest", "python", "python3"),
        noise=both(prefix("==="), lacks("FAILED", "ERROR", "passed", "error"))
        + prefix("collecting ", "collected ") + regex(r"^[.FEsxX ]+\z"),
        success=prefix("PASSED") + both(contains(" passed"), prefix("===")),
        error=prefix(
            "FAILED", "ERROR", "E   ", "Traceback (most recent call last)", "AssertionError",
            "_ _ _", "ERRORS",
        ),
    ),
    "git": Profile(
        commands=("git", "gh"),
        noise=equals('no changes added to commit (use "git add" and/or "git commit -a")')
        + prefix('  (use "git', '\t(use "git', "hint:"),
        error=prefix("error:", "fatal:", "CONFLICT"),
    ),
    "node": Profile(
        commands=("npm", "npx", "yarn", "pnpm", "bun"),
        noise=regex("^(?i)(npm warn|npm notice|npm info|yarn warn)")
        + prefix("  WARN ", "  notice ", "  http fetch", "  http request")
        + contains("No repository field", "No license field")
        + both(prefix("bun install"), contains("Resolving")),
        success=both(contains("added"), contains("packages"))
        + contains("Done in ") + prefix("success ", "✓"),
    ),
    "docker": Profile(
        commands=("docker", "docker-compose"),
        noise=prefix("--->", "Sending build context", "CACHED ") + regex(r"^[0-9a-fA-F]{12}\z"),
        success=prefix("Successfully built", "Successfully tagged", "FINISHED"),
        trimmed=("noise",),
    ),
    "gradle": Profile(
        commands=("gradle", "gradlew", "./gradlew"),
        noise=prefix("> Configure project", "Incremental java compilation")
        + both(prefix("Note: "), contains("uses unchecked"))
        + both(prefix("Note: "), contains("Recompile with")),
        success=both(contains(" tests, "), contains(" failures, 0")) + prefix("BUILD SUCCESSFUL"),
        error=prefix("BUILD FAILED", "FAILURE:", "* What went wrong:", "FAILED"),
    ),
    "maven": Profile(
        commands=("mvn", "mvnw", "./mvnw"),
        noise=prefix("[INFO] ---", "[INFO] Building", "[INFO] Scanning"),
        success=contains("BUILD SUCCESS")
        + both(contains("Tests run: "), contains("Failures: 0, Errors: 0")),
        error=contains("BUILD FAILURE") + prefix("[ERROR]"),
    ),
    "kubectl": Profile(
        commands=("kubectl", "k9s"),
        noise=both(prefix("Warning:"), contains("deprecated"))
        + regex(r"^I(?s:.*)"),
        success=suffix("configured", "created", "unchanged", "deleted"),
        error=prefix("Error from server", "error:", "Error:")
        + contains("CrashLoopBackOff", "ImagePullBackOff", "OOMKilled"),
    ),
    "aws": Profile(
        commands=("aws",),
        noise=contains("NextToken", "NextPageToken", '"Marker":'),
        error=prefix("An error occurred", "ERROR")
        + contains("AccessDenied", "NoCredentialsError", "ValidationError"),
    ),
    "tsc": Profile(
        commands=("tsc",),
        noise=equals("") + prefix("Version ", "TSFILE:"),
        success=equals("Found 0 errors.") + prefix("Found 0 errors. Watching"),
        error=contains(": error TS") + both(contains(" errors"), lacks("0 errors"))
        + prefix("error TS"),
    ),
    "jest": Profile(
        commands=("jest", "vitest"),
        noise=prefix("  console.", "  at node_modules/", "●")
        + both(contains(" at Object."), contains("node_modules")),
        success=prefix("✓ ", "✔ ", "  ✓ ", "PASS ") + both(contains("passed"), contains("Tests:")),
        error=prefix("FAIL ", "✕ ", "  ✕ ", "  × ") + contains("● "),
    ),
    "eslint": Profile(
        commands=("eslint", "biome", "oxc"),
        noise=(Test("blank"),) + prefix("  ("),
        success=contains("0 problems", "0 errors, 0 warnings") + prefix("✔ No lint"),
        error=contains(" error ") + both(contains(" errors"), lacks("0 errors"))
        + prefix("  error "),
    ),
    "prisma": Profile(
        commands=("prisma",),
        noise=prefix("Prisma schema loaded", "Running seed command", "Environment variables loaded"),
        success=contains("migrations applied", "Your database is now in sync") + prefix("✔"),
        error=prefix("Error:") + contains("migration failed", "P1", "P2", "P3"),
    ),
    "terraform": Profile(
        commands=("terraform", "tofu"),
        noise=prefix("  Reading...", "  Refreshing state...")
        + both(prefix("data."), contains(": Reading...")),
        success=prefix("Apply complete!", "Plan:", "No changes."),
        error=prefix("Error:", "│ Error") + contains("error occurred"),
    ),
    "make": Profile(
        commands=("make", "gmake"),
        noise=both(prefix("make["), contains("Entering directory"))
        + both(prefix("make["), contains("Leaving directory")),
        error=both(prefix("make:"), contains("Error")) + both(prefix("make["), contains("Error"))
        + both(contains("recipe for target"), contains("failed")),
    ),
    "ruby": Profile(
        commands=("bundle", "rake", "ruby", "gem"),
        noise=prefix("Fetching ", "Installing ", "Resolving dependencies..."),
        success=prefix("Bundle complete!")
        + contains(" examples, 0 failures", "passed, 0 failures"),
        error=prefix("Bundler::") + contains("FAILED")
        + both(contains(" failures"), lacks("0 failures"))
        + both(prefix("rspec"), contains("failure")),
    ),
    "dotnet": Profile(
        commands=("dotnet",),
        noise=prefix("  Determining projects to restore", "  Restored "),
        success=contains("Build succeeded", "Test Run Successful")
        + both(contains("Passed!"), contains("Failed:     0")),
        error=contains("Build FAILED") + prefix("Error")
        + both(contains("Failed:"), lacks("Failed:     0")),
    ),
    "grep": Profile(
        commands=("grep", "rg", "ag", "fzf"),
        error=prefix("grep:", "rg:") + contains(": Permission denied"),
    ),
}

PROFILE_OF = {cmd: name for name, profile in PROFILES.items() for cmd in profile.commands}


def _pattern(role: Role) -> str:
    anchored, anywhere = [], []
    for alternative in role:
        group = (alternative,) if isinstance(alternative, Test) else alternative
        if len(group) == 1 and group[0].op == "contains":
            anywhere.append(group[0].regex().removeprefix("(?s:.*?)"))
        else:
            anchored.append("".join(f"(?{'!' if t.negate else '='}{t.regex()})" for t in group))
    if anywhere:
        anchored.append(f"(?s:.*?)(?:{'|'.join(anywhere)})")
    return f"(?:{'|'.join(anchored)})"


def _by_profile(role: str, profile: Column, text: Column, general: Role | None) -> Column:
    own = {name: spec for name, spec in PROFILES.items() if getattr(spec, role) is not None}
    branches = [f"{name}\\x00{_pattern(getattr(spec, role))}" for name, spec in own.items()]
    if general:
        branches.append(rf"\x00{_pattern(general)}")
    trimmed = [name for name, spec in own.items() if role in spec.trimmed]
    subject = F.concat(
        F.when(profile.isin(list(own)), profile).otherwise(""),
        F.lit("\x00"),
        F.when(profile.isin(trimmed), trim_space(text)).otherwise(text),
    )
    return subject.rlike(f"^(?:{'|'.join(branches)})")


# Fixed value: a kubectl line that starts with I is noise when it is longer than this in bytes.
KUBECTL_INFO_BYTES = 20


def is_noise(profile: Column, text: Column) -> Column:
    """Progress chatter of the tool."""
    short_info = (
        (profile == "kubectl")
        & text.startswith("I")
        & (F.octet_length(text) <= KUBECTL_INFO_BYTES)
    )
    return _by_profile("noise", profile, text, None) & ~F.coalesce(short_info, F.lit(False))


def is_success(profile: Column, text: Column) -> Column:
    return _by_profile("success", profile, text, GENERAL_SUCCESS)


def is_error(profile: Column, text: Column) -> Column:
    return _by_profile("error", profile, text, GENERAL_ERROR)


# Stack frames, search hits and long directory listings.
STACK_FRAME = (
    r"^\s+at\s",
    r"^\s+\tat\s",
    r"^\t\S",
    r'^\s*File ".*", line \d+',
    r"^\s*\d+:\s+\S",
    r"^goroutine\s+\d+\s+\[",
    r"^\s+\.\.\.(\s+\d+\s+more)",
)
GREP_HIT = r"^[^:]+:\d+:"
LS_LONG = r"^[dlcbps-][rwx-]{9}\s"


def is_stack_frame(text: Column) -> Column:
    return text.rlike(any_of(STACK_FRAME))


def is_grep_hit(text: Column) -> Column:
    return text.rlike(to_java(GREP_HIT))


def is_ls_long(text: Column) -> Column:
    return text.rlike(to_java(LS_LONG))
