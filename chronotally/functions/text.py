"""Text classifiers and cleaners as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# fixed values: tool names (small letters) by category
TOOLS = {
    "shell": ("bash", "shell", "run_shell_command", "execute", "run_command", "run_terminal_cmd", "exec_command", "exec", "write_stdin", "local_shell", "shell_command", "container.exec", "bashoutput", "killshell", "killbash"),
    "file_read": ("read", "read_file", "read_many_files", "view_image"),
    "file_write": ("write", "write_file", "create_file"),
    "file_edit": ("edit", "multiedit", "replace", "apply_patch", "str_replace", "str_replace_editor", "edit_file", "delete", "delete_file", "remove_file"),
    "notebook": ("notebookedit", "notebook_edit"),
    "search": ("glob", "grep", "search_file_content", "list_directory", "ls", "codebase_search", "grep_search", "file_search"),
    "web": ("webfetch", "websearch", "web_fetch", "web_search", "google_web_search"),
    "subagent": ("task", "agent", "spawn_agent", "wait_agent", "list_agents", "followup_task", "send_message", "interrupt_agent", "close_agent", "resume_agent"),
    "plan": ("enterplanmode", "exitplanmode", "todowrite", "todo_write", "update_plan", "enter_plan_mode", "exit_plan_mode", "write_todos", "askuserquestion", "request_user_input", "request_user_input_async", "ask_user"),
    "mcp": ("list_mcp_resources", "list_mcp_resource_templates", "read_mcp_resource"),
}
# fixed values: phrases (small letters) of failure texts, in the order in which they are tried
FAILURES = (
    ("string_mismatch", ("string to replace not found", "old_string")),
    ("file_not_found", ("no such file", "not found", "enoent", "does not exist")),
    ("permission_denied", ("permission denied", "eacces", "eperm")),
    ("timeout", ("timed out", "timeout")),
    ("interrupted", ("interrupted", "cancelled", "canceled", "aborted")),
)
# fixed values: how the parts of a command line rank, strongest first
CATEGORY_ORDER = ("git", "test", "build", "install", "network", "run", "fs", "other")
GIT_ORDER = ("commit", "push", "pull", "merge", "rebase", "cherry-pick", "revert", "reset", "checkout", "switch", "stash", "tag", "clone", "fetch", "add", "rm", "mv", "branch", "worktree", "status", "log", "diff", "show")
FINE_ORDER = ("git.commit", "deploy", "git.push", "test.run", "pkg.test", "infra.iac", "infra.k8s", "infra.docker", "github.pr_write", "git.rewrite", "git.branch", "db.client", "pkg.build", "build.sys", "lint.run", "pkg.lint", "pkg.install")
# fixed values: programs that stand before the one that counts, and programs by category
WRAPPERS = ("sudo", "env", "time", "nohup", "exec", "command", "nice")
SHELLS = ("bash", "sh", "zsh", "dash", "fish")
PACKAGE_RUNNERS = ("npx", "bunx", "pnpx")
MANAGERS = ("npm", "pnpm", "yarn", "bun")
MANAGER_INSTALLS = ("install", "i", "ci", "add", "remove", "rm", "update", "up", "upgrade", "link")
BY_SUBCOMMAND = (
    (("cargo",), {"test": ("test", "nextest"), "build": ("build", "check", "clippy", "doc"), "run": ("run",), "install": ("add", "install", "update", "fetch")}),
    (("go",), {"test": ("test",), "build": ("build", "vet", "generate"), "run": ("run",), "install": ("get", "mod", "install")}),
    (("swift", "dotnet", "mix"), {"test": ("test",), "build": ("build",), "run": ("run",)}),
    (("docker", "podman"), {"build": ("build",), "run": ("run", "compose", "exec", "up"), "network": ("push", "pull", "login")}),
    (("pip", "pip3", "uv", "poetry", "brew", "apt", "apt-get", "gem", "composer", "conda"), {"install": ("install", "i", "add", "sync", "remove", "uninstall", "upgrade", "update")}),
)
BY_PROGRAM = (
    ("build", ("make", "cmake", "ninja", "tsc", "webpack", "esbuild", "rollup", "gradle", "gradlew", "mvn", "xcodebuild", "xcodegen")),
    ("test", ("jest", "vitest", "pytest", "mocha", "rspec", "phpunit", "playwright", "cypress", "ava")),
    ("run", ("node", "python", "python3", "deno", "ruby", "php", "java", "uvicorn", "flask", "rails", "ts-node", "tsx")),
    ("network", ("curl", "wget", "ssh", "scp", "rsync", "ping", "nc", "dig", "nslookup", "gh", "http", "aws", "gcloud", "vercel", "firebase", "supabase", "netlify", "fly", "flyctl", "heroku", "kubectl")),
    ("fs", ("ls", "cat", "head", "tail", "sed", "awk", "grep", "rg", "find", "fd", "mkdir", "rm", "cp", "mv", "touch", "chmod", "chown", "ln", "pwd", "cd", "echo", "tree", "wc", "sort", "uniq", "diff", "stat", "du", "df", "tar", "zip", "unzip", "which", "xargs", "tee", "cut", "basename", "dirname", "realpath", "readlink")),
)
# fixed values: subcategories by git's subcommand, by a package manager's target and by program (None: of all others)
GIT_FINE = {None: "git.other", "git.commit": ("commit",), "git.push": ("push",), "git.sync": ("pull", "fetch"), "git.read": ("diff", "log", "status", "show", "blame"), "git.rewrite": ("rebase", "merge", "cherry-pick", "revert", "reset"), "git.branch": ("checkout", "switch", "branch", "stash")}
MANAGER_FINE = {None: "pkg.other", "pkg.test": ("test", "t"), "pkg.install": ("install", "i", "add", "remove", "uninstall"), "pkg.build": ("build", "tsc", "typecheck"), "pkg.lint": ("lint", "format", "prettier", "eslint", "biome"), "pkg.run": ("dev", "start", "serve")}
FINE = (
    ("test.run", ("pytest", "jest", "vitest", "mocha", "rspec", "phpunit")),
    ("lint.run", ("tsc", "eslint", "prettier", "ruff", "black", "mypy", "biome")),
    ("infra.docker", ("docker",)),
    ("infra.k8s", ("kubectl", "helm", "k9s")),
    ("infra.iac", ("terraform", "tofu", "pulumi")),
    ("net.request", ("curl", "wget", "http", "httpie")),
    ("fs.mutate", ("rm", "mv", "cp", "chmod", "chown")),
    ("fs.read", ("ls", "cat", "head", "tail", "less", "more", "wc", "tree")),
    ("fs.search", ("find", "grep", "rg", "fd", "ag", "fzf", "ack")),
    ("fs.create", ("mkdir", "touch", "ln")),
    ("db.client", ("supabase", "psql", "sqlite3", "mysql", "redis-cli", "mongo", "mongosh")),
    ("deploy", ("vercel", "netlify", "fly", "gcloud", "aws", "eb", "heroku", "railway")),
    ("runtime", ("python", "python3", "node", "deno", "ruby", "go", "cargo", "rustc", "java")),
    ("build.sys", ("make", "cmake", "gradle", "mvn", "sbt", "ninja")),
    ("shell.builtin", ("echo", "printf", "env", "export", "source", "alias")),
    ("shell.nav", ("cd", "pwd", "pushd", "popd")),
    ("pkg.system", ("brew", "apt", "apt-get", "pacman", "yum", "dnf")),
    ("net.transfer", ("ssh", "scp", "rsync")),
    ("editor", ("open", "code", "cursor", "nano", "vim", "emacs", "subl")),
    ("mobile.expo", ("expo",)),
    ("mobile.build", ("eas", "fastlane", "xcodebuild")),
)
GIT_SUBCOMMAND = r"^(?>(?:-C|-c|--git-dir|--work-tree)\s+\S+(?:\s+|$)|-\S*(?:\s+|$))*+([^\s-]\S*)"
EXIT_CODE = r"(?:exit code|exit status|exited with code|exited with|returned exit code) (-?[0-9]+)"
# fixed values: shapes of secrets and the rule that masks them
SECRETS = (
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----"),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    ("aws", r"\bAKIA[0-9A-Z]{16}\b"),
    ("github", r"\bgh[pousr]_[A-Za-z0-9]{20,}"),
    ("openai", r"\bsk-[A-Za-z0-9_-]{16,}"),
    ("slack", r"\bxox[abprs]-[A-Za-z0-9-]{10,}"),
    ("google", r"\bAIza[0-9A-Za-z_-]{30,}"),
)
URL_CREDENTIALS = r"([a-z][a-z0-9+.-]*://)[^/\s:@]+:[^/\s@]+@"
ASSIGNMENT = r"((?:token|secret|password|passwd|api_key|apikey)\s*[=:]\s*[\"']?)[A-Za-z0-9_/+.-]{8,}"
INVISIBLE = r"[\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}-\x{2064}\x{feff}]"


def classify_tool(name: Column) -> Column:
    lower = F.lower(name)
    out = F.when(lower.startswith("mcp_") | lower.startswith("mcp:"), "mcp")
    for category, names in TOOLS.items():
        out = out.when(lower.isin(*names), category)
    return out.when(name.isNotNull(), "other")


def classify_failure(text: Column) -> Column:
    lower = F.lower(text)
    has = lambda words: F.greatest(*[lower.contains(w) for w in words]) if len(words) > 1 else lower.contains(words[0])
    out = F.when(text.isNull(), None)
    for name, words in FAILURES:
        out = out.when(has(words), name)
    return out.when(exit_code(text).isNotNull() | has(("non-zero", "nonzero")), "nonzero_exit").otherwise("other")


def exit_code(text: Column) -> Column:
    found = F.regexp_extract(F.lower(text), EXIT_CODE, 1)
    return F.when(found != "", found.try_cast("int"))


def _segment_facts(segment: Column, place: Column) -> Column:
    """rank, git_rank, place, category, git_subcommand and subcategory of one command of a chain; the least struct is the strongest."""
    plain = F.regexp_replace(segment, rf"^(?:(?:[A-Za-z_][A-Za-z0-9_]*=\S*|{'|'.join(WRAPPERS)})(?:\s+|$))+", "")
    plain = F.regexp_replace(plain, rf"^(?:(?:{'|'.join(PACKAGE_RUNNERS)})\s+)+", "")
    shelled = rf"^(?:\S*/)?(?:{'|'.join(SHELLS)})(?=\s|$)"
    inner = F.regexp_replace(plain, shelled + r"(?:\s+-\S*)*\s*", "")
    tokens = F.filter(F.split(F.when(plain.rlike(shelled), inner).otherwise(plain), r"\s+"), lambda t: t != "")

    def facts(t: Column) -> Column:
        first = F.get(t, F.lit(0))
        program = F.regexp_replace(F.substring_index(first, "/", -1), "^['\"]+|['\"]+$", "")
        rest = F.slice(t, 2, F.greatest(F.size(t), F.lit(1)))
        words = F.filter(rest, lambda x: ~x.startswith("-"))
        sub, script = F.get(words, F.lit(0)), F.get(words, F.lit(1))
        following, second = F.coalesce(F.get(rest, F.lit(0)), F.lit("")), F.coalesce(F.get(rest, F.lit(1)), F.lit(""))
        git = F.lower(F.regexp_extract(F.array_join(rest, " "), GIT_SUBCOMMAND, 1))
        git = F.when((program == "git") & (git != ""), git)
        managed = F.coalesce(sub, F.lit("install"))
        script_kind = F.when(script.startswith("test") | script.contains(":test") | script.contains("test:"), "test").when(script.startswith("build") | script.contains(":build"), "build").otherwise("run")
        manager = F.when(managed.isin(*MANAGER_INSTALLS), "install").when(managed.isin("test", "t") | managed.startswith("test"), "test").when(managed.isin("run", "run-script"), script_kind).when(managed.startswith("build"), "build").when(managed.startswith("lint") | managed.startswith("format"), "other").otherwise("run")
        category = F.when(first.isNull(), F.when(plain.rlike(shelled), "run").otherwise("other")).when(program == "git", "git").when(program.isin(*MANAGERS), manager)
        for programs, by_sub in BY_SUBCOMMAND:
            own = F.lit("other")
            for name, subs in by_sub.items():
                own = F.when(sub.isin(*subs), name).otherwise(own)
            category = category.when(program.isin(*programs), own)
        for name, programs in BY_PROGRAM:
            category = category.when(program.isin(*programs), name)
        category = category.when(first.startswith("./") | program.rlike(r"\.(sh|py|js)$"), "run").otherwise("other")
        target = F.when(following == "run", second).otherwise(following)
        fine = F.when(first.isNull(), "unknown")
        for names, value, otherwise in (("git", git, GIT_FINE), (MANAGERS, target, MANAGER_FINE)):
            own = F.lit(otherwise[None])
            for label, values in otherwise.items():
                if label:
                    own = F.when(value.isin(*values), label).otherwise(own)
            fine = fine.when(program.isin(*([names] if isinstance(names, str) else names)), own)
        fine = fine.when(program == "gh", F.when((following == "pr") & second.isin("create", "merge"), "github.pr_write").otherwise("github.other"))
        fine = fine.when(program.isin("go", "cargo") & (following == "test"), "test.run")
        for label, programs in FINE:
            fine = fine.when(program.isin(*programs), label)
        rank = lambda value, order, none: F.coalesce(F.array_position(F.array(*map(F.lit, order)), value) - 1, F.lit(none))
        at = lambda r, n: F.when(r < 0, n).otherwise(r).cast("int")
        git_rank = F.when(git.isNull(), len(GIT_ORDER) + 1).otherwise(at(rank(git, GIT_ORDER, -1), len(GIT_ORDER)))
        return F.struct(at(rank(category, CATEGORY_ORDER, -1), len(CATEGORY_ORDER)).alias("rank"), git_rank.alias("git_rank"), place.alias("place"), category.alias("category"), git.alias("git_subcommand"), fine.otherwise("unknown").alias("subcategory"))

    return F.transform(F.array(tokens), facts)[0]


def command_facts(command: Column) -> Column:
    """category, git_subcommand and subcategory of a command line: of a chain, the strongest command's; null for none.

    The strongest is the first in ``CATEGORY_ORDER`` and then in ``GIT_ORDER``; the subcategory is a chain's first in ``FINE_ORDER``, else its first command's.
    """
    segments = F.filter(F.transform(F.split(command, r"&&|\|\||[&|;\n]"), lambda s: F.trim(F.regexp_replace(s, r"^\s+|\s+$", ""))), lambda s: s != "")
    parts = F.transform(segments, _segment_facts)
    ranked = lambda p: F.struct(F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, FINE_ORDER)), p["subcategory"]).cast("int"), F.lit(0)), F.lit(len(FINE_ORDER) + 1)).alias("r"), p["place"].alias("place"), p["subcategory"].alias("s"))

    def chosen(p: Column) -> Column:
        best, fine = F.array_min(p), F.array_min(F.transform(p, ranked))
        empty = F.size(p) == 0
        subcategory = F.when(empty, "unknown").when(fine["r"] <= len(FINE_ORDER), fine["s"]).otherwise(F.get(p, F.lit(0))["subcategory"])
        return F.struct(F.coalesce(best["category"], F.lit("other")).alias("category"), best["git_subcommand"].alias("git_subcommand"), F.when(F.size(p) == 1, p[0]["subcategory"]).otherwise(subcategory).alias("subcategory"))

    return F.when(command.isNotNull(), F.transform(F.array(parts), chosen)[0])


def classify_command(command: Column) -> Column:
    return command_facts(command)["category"]


def git_subcommand(command: Column) -> Column:
    return command_facts(command)["git_subcommand"]


def test_counts(output: Column) -> Column:
    """passed, failed, skipped of the last 8 KiB of a test runner's output; null if no runner is recognised."""
    tail = F.substring(F.lower(output), -8192, 8192)
    total = lambda rx: F.aggregate(F.transform(F.regexp_extract_all(tail, F.lit(rx), F.lit(1)), lambda x: x.cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    passed, failed, skipped = total(r"(\d{1,9}) (?:passed|passing|ok\b)"), total(r"(\d{1,9}) (?:failed|failing|failures?\b)"), total(r"(\d{1,9}) (?:skipped|ignored|pending|todo)")
    known = tail.rlike(r"\d{1,9} (passed|passing|failed|failing|skipped|ignored|pending)")
    return F.when(known, F.struct(passed.alias("passed"), failed.alias("failed"), skipped.alias("skipped")))


def redact(text: Column) -> Column:
    """Secrets replaced by [REDACTED:rule]."""
    for rule, rx in SECRETS:
        text = F.regexp_replace(text, rx, f"[REDACTED:{rule}]")
    text = F.regexp_replace(text, URL_CREDENTIALS, "$1[REDACTED:url]@")
    return F.regexp_replace(text, "(?i)" + ASSIGNMENT, "$1[REDACTED:assignment]")


def strip_invisible(text: Column) -> Column:
    return F.regexp_replace(text, INVISIBLE, "")


def cell(text: Column, most: int = 8192) -> Column:
    """Long values cut, with the length that was cut off."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("… +"), (F.length(text) - most).cast("string"))).otherwise(text)


def remote(url: Column) -> Column:
    """host/owner/repo of a repository address."""
    plain = F.regexp_replace(F.trim(url), r"^(?:[a-z+]+://)?(?:[^@/]+@)?", "")
    plain = F.regexp_replace(plain, r"^([^/:]+):(?:[0-9]+/)?", "$1/")
    return F.lower(F.regexp_replace(F.regexp_replace(plain, r"/+$", ""), r"\.git$", ""))


def relative_path(path: Column, root: Column) -> Column:
    inside = path.startswith(F.concat(F.rtrim(root), F.lit("/")))
    return F.when(inside, F.substr(path, F.length(root) + 2)).otherwise(path)


def line_delta(old: Column, new: Column) -> Column:
    """Lines added and removed by replacing ``old`` with ``new``."""
    lines = lambda c: F.when(F.coalesce(c, F.lit("")) == "", 0).otherwise(F.size(F.split(c, "\n")))
    return F.struct(lines(new).cast("long").alias("added"), lines(old).cast("long").alias("removed"))


def clean_attrs(attrs: Column, allowed) -> Column:
    """Allowed keys whose values are short, of one line, and hold no address of a person or home folder."""
    fine = lambda v: (F.length(v) <= 256) & ~v.contains("\n") & ~v.rlike(r"[^\s@]+@[^\s@]+\.[a-z]{2,}|/(home|Users)/[^/]+")
    return F.map_filter(attrs, lambda k, v: k.isin(*allowed) & F.coalesce(fine(v), F.lit(False)))
