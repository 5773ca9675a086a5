"""Row filters that say why they drop."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import basename

#: Name of each predicate of the noise filter and whether it is on by default, in the order in which they are asked.
NOISE = {"event_receiver": True, "vscode": True, "shell_startup": True, "git": True, "proc_polling": True, "process_inventory": True, "sleep_polling": False}

# What counts as operational noise, and the reasons given.
REASONS = {
    "event_receiver": "event receiver server operational noise",
    "vscode": "vscode server operational noise",
    "shell_startup": "shell startup helper noise",
    "git": "development git background query noise",
    "proc_polling": "procfs polling noise",
    "process_inventory": "process inventory polling noise",
    "sleep_polling": "known sleep polling noise",
}
GIT_QUERIES = ("git config --get commit.template", "git status -z -uall", "git worktree list --porcelain")
GIT_REV_PARSE = tuple(f"git rev-parse {x}" for x in ("--show-toplevel", "--git-dir", "--git-common-dir", "--show-superproject-working-tree", "--is-inside-work-tree"))
PS = "/usr/bin/ps -ax -o pid=,ppid=,pcpu=,pmem=,command="
INVENTORY_ARGS = (["which", "ps"], ["/bin/sh", "-c", "which ps"], PS.split(" "), ["/bin/sh", "-c", PS])
INVENTORY_LINES = ("which ps", "/bin/sh -c 'which ps'", PS, f"/bin/sh -c '{PS}'")
SED_ARGS = ["sed", "-n", r"s/^cpu\s//p", "/proc/stat"]


def first_reason(rules: Iterable[tuple[str, Column]]) -> Column:
    """The reason of the first predicate that holds; null if none does. A null predicate does not hold."""
    return F.coalesce(*[F.when(predicate, F.lit(reason)) for reason, predicate in rules], F.lit(None).cast("string"))


def split_by(df: DataFrame, reason: Column, reason_col: str = "drop_reason") -> tuple[DataFrame, DataFrame]:
    """(kept rows, dropped rows with their reason)."""
    marked = df.withColumn(reason_col, reason)
    return marked.where(F.col(reason_col).isNull()).drop(reason_col), marked.where(F.col(reason_col).isNotNull())


def noise_reason(name: Column, executable: Column, command_line: Column, args: Column, **toggles: bool) -> Column:
    """Why a process event is operational noise, or null. Toggles are the keys of NOISE."""
    if unknown := toggles.keys() - NOISE.keys():
        raise ValueError(f"unknown toggles: {sorted(unknown)}")
    on = NOISE | toggles
    name, executable, command_line = (F.coalesce(c, F.lit("")) for c in (name, executable, command_line))
    args = F.coalesce(F.filter(args, lambda a: a.isNotNull()), F.array().cast("array<string>"))
    base = basename(executable)
    text = F.concat_ws(" ", *[F.nullif(c, F.lit("")) for c in (name, executable, command_line, F.array_join(args, " "))])
    is_args = lambda words: args == F.array(*map(F.lit, words))
    either = lambda *names: name.isin(*names) | base.isin(*names)
    git_args = (F.get(args, 0) == "git") & (F.get(args, 1) == "rev-parse")
    is_rev_parse = F.array_join(args, " ").isin(*GIT_REV_PARSE) & (F.size(args) == 3)
    git = (
        F.when(~either("git"), False)
        .when(F.coalesce((F.get(args, 0) == "git") & (F.get(args, 1) == "for-each-ref"), F.lit(False)), True)
        .when(is_args(GIT_QUERIES[0].split()) | is_args(GIT_QUERIES[1].split()) | is_args(GIT_QUERIES[2].split()), True)
        .when(F.coalesce(git_args, F.lit(False)), is_rev_parse)  # arguments decide, whatever the command line says
        .otherwise(command_line.isin(*GIT_QUERIES, *GIT_REV_PARSE) | command_line.startswith("git for-each-ref "))
    )
    inventory = command_line.isin(*INVENTORY_LINES)
    for words in INVENTORY_ARGS:
        inventory = inventory | is_args(words)
    # a final line feed may follow, as in "$" of most regular expressions
    stat = (base == "cat") & (F.size(args) == 2) & F.coalesce(F.get(args, 1).rlike(r"(?U)^/proc/\d+/stat\n?\z"), F.lit(False))
    predicates = {
        "event_receiver": text.contains("event_receiver_server.py"),
        "vscode": text.contains(".vscode-server") | ((base == "node") & F.lower(text).contains("vscode")),
        "shell_startup": F.when(either("dircolors"), is_args(["dircolors", "-b"]) | (command_line == "dircolors -b")).otherwise(text.contains("lesspipe") & either("dash", "sh", "basename", "dirname")),
        "git": git,
        "proc_polling": (name == "cpuUsage.sh") | executable.contains("cpuUsage.sh") | command_line.contains("cpuUsage.sh") | ((base == "sed") & is_args(SED_ARGS)) | stat,
        "process_inventory": inventory,
        "sleep_polling": either("sleep") & (is_args(["sleep", "1"]) | (command_line == "sleep 1")),
    }
    return first_reason((REASONS[k], predicates[k]) for k in NOISE if on[k])


def document_noise(**toggles: bool) -> Column:
    """The noise filter over a document's process fields."""
    return noise_reason(F.col("process.name"), F.col("process.executable"), F.col("process.command_line"), F.col("process.args"), **toggles)


def endpoint_reason(ip: Column, port: Column, outbound: Column, endpoints: Iterable[tuple[str, int]]) -> Column:
    """Reason to drop outbound connections to listed endpoints; null for all others."""
    listed = F.lit(False)
    for host, number in endpoints:
        listed = listed | ((ip == host) & (port == number))
    return F.when(outbound & listed, F.concat(F.lit("agent telemetry connection "), ip, F.lit(":"), port.cast("string")))
