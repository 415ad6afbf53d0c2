"""Expressions over command strings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from logcompact.functions.text import trim_space, words

# A command that mentions one of these is never compacted.
SECURITY_KEYWORDS = (
    "audit", "vuln", "vulnerability", "security",
    "snyk", "trivy", "cve", "scan", "owasp",
    "grype", "semgrep", "gosec", "bandit",
)

# Shell words and small utilities that are passed through.
IGNORED_COMMANDS = (
    "cd", "echo", "printf", "export", "source", ".", "mkdir", "rm",
    "mv", "cp", "chmod", "chown", "touch", "which", "type", "test",
    "true", "false", "sleep", "wait", "kill", "set", "unset", "sort",
    "uniq", "tr", "cut", "awk", "sed", "pwd", "bash", "sh",
    "zsh", "fish", "then", "else", "do", "for", "while", "if",
    "case", "env", "exec", "eval", "read", "exit", "return",
)
# A wrapper must not wrap itself: the caller lists the names it is installed under.
OWN_NAMES = ("logcompact",)

# Destructive commands.
DENIED_COMMANDS = ("dd", "mkfs", "fdisk", "parted", "shred", "wipefs")

# Shell syntax, sudo flags (u g C r t take a value) and variable assignments.
SHELL_META = r"[|><;`]|\$\(|&&"
SUDO_FLAGS = r"^(-[ugCrt]( [^ ]+)?( |$)|-[^ ]*( |$))*"
ENV_PREFIX = r"^([A-Za-z_][A-Za-z0-9_]*=[^ \t\n\f\r]*[ \t\n\f\r]+)+"


def full_command(command: Column, args: Column) -> Column:
    return F.concat_ws(" ", command, F.nullif(args, F.lit("")))


def command_key(command: Column, args: Column) -> Column:
    """Key of equal invocations; the space stays when there are no arguments."""
    return F.md5(F.concat(command, F.lit(" "), F.coalesce(args, F.lit(""))))


def basename(path: Column) -> Column:
    bare = F.rtrim(path, F.lit("/"))
    return (
        F.when(path == "", ".")
        .when(bare == "", "/")
        .otherwise(F.element_at(F.split(bare, "/"), -1))
    )


def without_sudo(command: Column) -> Column:
    """Drop a leading sudo and its flags."""
    after = F.substring(command, F.lit(5), F.char_length(command))
    called = command.startswith("sudo") & (
        (after == "") | after.startswith(" ") | after.startswith("-")
    )
    rest = F.regexp_replace(F.array_join(words(after), " "), SUDO_FLAGS, "")
    return F.when(called, rest).otherwise(command)


def normalize_command(command: Column) -> Column:
    """Struct (env_prefix, base, args) of a command string, without sudo and directory."""
    bare = without_sudo(trim_space(command))
    env_prefix = F.regexp_extract(bare, ENV_PREFIX, 0)
    call = F.substring(bare, F.char_length(env_prefix) + 1, F.char_length(bare))
    head = F.substring_index(call, " ", 1)
    tail = F.substring(call, F.char_length(head) + 2, F.char_length(call))
    return F.struct(
        env_prefix.alias("env_prefix"),
        basename(head).alias("base"),
        trim_space(tail).alias("args"),
    )


def has_shell_meta(command: Column) -> Column:
    return command.rlike(SHELL_META)


def is_security(command: Column, args: Column) -> Column:
    """The command or its arguments mention a security tool; part of a word is enough."""
    whole = F.lower(F.concat_ws(" ", command, F.coalesce(args, F.lit(""))))
    found = F.lit(False)
    for keyword in SECURITY_KEYWORDS:
        found = found | whole.contains(keyword)
    return found


def is_excluded(command: Column, excluded: Sequence[str]) -> Column:
    if not excluded:
        return F.lit(False)
    return F.lower(command).isin([name.lower() for name in excluded])


def is_interactive(args: Column, prefixes: Column) -> Column:
    """A call that needs a terminal: a listed subcommand, or run/exec with an interactive flag."""
    listed = F.exists(prefixes, lambda p: (args == p) | args.startswith(F.concat(p, F.lit(" "))))
    lowered = F.lower(args)
    attached = (lowered.startswith("run ") | lowered.startswith("exec ")) & (
        args.contains("-it") | args.contains("-i ") | args.contains("--interactive")
    )
    return F.coalesce(listed, F.lit(False)) | attached


__all__ = [
    "basename", "command_key", "full_command", "has_shell_meta",
    "is_excluded", "is_interactive", "is_security", "normalize_command", "without_sudo",
]
