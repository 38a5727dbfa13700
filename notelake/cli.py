"""Command line: ``python -m notelake.cli --root DIR COMMAND``."""

from __future__ import annotations

import argparse
import json
import time
import tomllib
from pathlib import Path

from pyspark.sql import SparkSession

from .api import Notes
from .functions.columns import glob_regex
from .operators.notes import noisy_directories
from .sources import vault


def vaults(config: dict) -> dict[str, str]:
    """A single ``[vault]`` is named default; ``[vaults]`` maps names to folders; without either the working folder."""
    one = {"default": config["vault"]["path"]} if "vault" in config else {}
    return one | config.get("vaults", {}) or {"default": str(Path.cwd())}


def thesaurus(path: str | None) -> dict[str, list[str]]:
    return tomllib.loads(Path(path).read_text()) if path and Path(path).exists() else {}


def edit_thesaurus(path: str, word: str, synonyms: list[str], remove: bool) -> dict[str, list[str]]:
    known = thesaurus(path)
    left = [s for s in known.get(word, []) if not remove or (synonyms and s not in synonyms)]
    known[word] = left if remove else [*left, *(s for s in synonyms if s not in left)]
    if not known[word]:
        del known[word]
    Path(path).write_text("".join(f"{json.dumps(k)} = {json.dumps(v)}\n" for k, v in sorted(known.items())))
    return known


def synonyms(config: dict, path: str | None) -> dict[str, list[str]]:
    """The configuration's synonyms; a word that the thesaurus has goes by the thesaurus."""
    return config.get("synonyms", {}) | thesaurus(path)


def rendered(config: dict) -> str:
    """A configuration of scalars, lists and one level of tables as TOML."""
    plain = {k: v for k, v in config.items() if not isinstance(v, dict)}
    tables = {k: v for k, v in config.items() if isinstance(v, dict)}
    lines = [f"{k} = {json.dumps(v)}" for k, v in plain.items()]
    for name, table in tables.items():
        lines += ["", f"[{name}]", *(f"{json.dumps(k)} = {json.dumps(v)}" for k, v in table.items())]
    return "\n".join(lines).strip() + "\n"


def migrated(config: dict) -> dict:
    """The older form, one ``[vault]``, as ``[vaults]``; excludes of the vault come to the top."""
    if "vault" not in config:
        return config
    one = dict(config["vault"])
    rest = {k: v for k, v in config.items() if k != "vault"}
    rest["vaults"] = {"default": one.pop("path")} | rest.get("vaults", {})
    if "excludes" in one:
        rest["excludes"] = [*rest.get("excludes", []), *one.pop("excludes")]
    return rest


STARTER = {"excludes": [], "vaults": {}, "retention_days": {}, "server": {"host": "127.0.0.1", "port": 8080, "origins": []}}
SECRET = ("key", "token", "password", "secret")


def hidden(config: dict) -> dict:
    """The configuration for others' eyes: values of secret names are gone."""
    return {k: hidden(v) if isinstance(v, dict) else "[REDACTED]" if any(s in k.lower() for s in SECRET) else v for k, v in config.items()}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="notelake")
    p.add_argument("--root", required=True)
    p.add_argument("--config")
    p.add_argument("--thesaurus")
    sub = p.add_subparsers(dest="command", required=True)
    number, real, yes = {"type": int}, {"type": float}, {"action": "store_true"}

    def add(name: str, *flags, aliases=()):
        c = sub.add_parser(name, aliases=aliases)
        c.set_defaults(command=name)
        for f, k in flags:
            c.add_argument(f, **k)

    add("index", ("--from-scratch", yes))
    add("search", ("query", {}), ("--limit", number | {"default": 20}), ("--mode", {"default": "fts"}), ("--vault", {}), ("--tag-filter", {}), ("--since-date", {}), ("--min-score", real), ("--cursor", {}), ("--fuzzy", yes), ("--alpha", real), ("--mmr", yes), ("--mmr-lambda", real | {"default": 0.5}), ("--no-backlinks", yes), ("--dictionary", {"nargs": "*", "default": []}), ("--vector", {}), ("--lines", number | {"default": 5}), ("--chars", number | {"default": 200}))
    add("tasks", ("--keyword", {}), ("--all", yes))
    add("stats")
    add("list", ("--limit", number | {"default": 50}), ("--offset", number | {"default": 0}), ("--newest", yes))
    add("delete", ("vault", {}), ("path", {}))
    add("prune", ("--days", number), ("--vault", {"default": "default"}), ("--dry-run", yes))
    add("clean", ("--compact", yes), ("--rollback", number))
    add("watch", ("--every", real | {"default": 2.0}), ("--rounds", number))
    add("serve", ("--host", {}), ("--port", number), ("--key", {}))
    add("init", ("--vault", {"action": "append", "default": []}), ("--force", yes))
    add("setup", ("--vault", {"action": "append", "default": []}), ("--force", yes))
    add("config")
    add("config-migrate", ("--dry-run", yes))
    add("support")
    add("synonym", ("action", {"choices": ["add", "remove", "list"]}), ("word", {"nargs": "?"}), ("synonyms", {"nargs": "*"}))
    add("check-ignore", ("path", {}), ("patterns", {"nargs": "*"}))
    add("detect-noise", ("--threshold", number | {"default": 100}))
    add("doctor")
    return p


def without_engine(a: argparse.Namespace, config: dict) -> bool:
    """Commands that need no Spark; whether this was one."""
    if a.command == "synonym":
        print(json.dumps(thesaurus(a.thesaurus) if a.action == "list" else edit_thesaurus(a.thesaurus, a.word, a.synonyms, a.action == "remove")))
    elif a.command == "check-ignore":
        import re

        print(next((x for x in a.patterns if (g := glob_regex(x)) and re.match(g, a.path)), ""))
    elif a.command in ("init", "setup"):
        if not a.config:
            raise SystemExit("name the file with --config")
        if Path(a.config).exists() and not a.force:
            raise SystemExit(f"{a.config} is there; --force writes over it")
        folders = [v.partition("=") if "=" in v else ("default", "=", v) for v in a.vault] or [("default", "=", str(Path.cwd()))]
        Path(a.config).write_text(rendered(STARTER | {"vaults": {n: str(Path(f).absolute()) for n, _, f in folders}}))
        if a.command == "init":
            print(a.config)
            return True
        return False  # setup goes on and builds the index
    elif a.command == "config":
        print(rendered(hidden(config)), end="")
    elif a.command == "config-migrate":
        new = rendered(migrated(config))
        if not a.dry_run:
            Path(a.config).rename(a.config + ".old")
            Path(a.config).write_text(new)
        print(new, end="")
    else:
        return False
    return True


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    load = lambda: tomllib.loads(Path(a.config).read_text()) if a.config and Path(a.config).exists() else {}
    config = load()
    if without_engine(a, config):
        return
    config = load()
    spark = SparkSession.builder.getOrCreate()
    notes = Notes(spark, a.root)
    table = lambda df: print("\n".join(df.toJSON().collect()))
    if a.command in ("index", "setup"):
        if getattr(a, "from_scratch", False):
            notes.store.purge()
        table(notes.index(vaults(config), excludes=config.get("excludes", ())))
    elif a.command == "search":
        knobs = {k: getattr(a, k) for k in ("limit", "mode", "vault", "tag_filter", "since_date", "min_score", "cursor", "fuzzy", "alpha", "mmr", "mmr_lambda")}
        vector = json.loads(a.vector) if a.vector else None
        entries = {*a.dictionary, *config.get("dictionary", ())}
        out = notes.search(a.query, query_vector=vector, synonyms=synonyms(config, a.thesaurus), backlinks=not a.no_backlinks, user_dictionary=entries, **knobs)
        print(json.dumps({"results": notes.show(out, a.query, a.lines, a.chars), "mode": out.mode, "next_cursor": out.next_cursor}, ensure_ascii=False))
    elif a.command == "tasks":
        table(notes.tasks(a.keyword, a.all))
    elif a.command == "stats":
        table(notes.stats())
    elif a.command == "list":
        table(notes.history(a.limit, a.offset) if a.newest else notes.files(a.limit, a.offset))
    elif a.command == "delete":
        notes.delete(a.vault, a.path)
    elif a.command == "prune":
        days = {a.vault: a.days} if a.days is not None else config.get("retention_days", {})
        print(notes.prune(days, int(time.time() * 1000), dry_run=a.dry_run))
    elif a.command == "clean":
        print(notes.store.rollback(a.rollback) if a.rollback else notes.store.compact() if a.compact else notes.store.purge())
    elif a.command == "watch":
        from .streaming.watch import watch

        print(watch(notes.store, vaults(config), f"{a.root.rstrip('/')}-watch", every=a.every, rounds=a.rounds, excludes=config.get("excludes", ())))
    elif a.command == "serve":
        from .service import Service, serve

        own = config.get("server", {})
        service = Service(notes, a.key or own.get("api_key"), vaults(config), tuple(own.get("origins", ())), synonyms(config, a.thesaurus), set(config.get("dictionary", ())))
        serve(service, a.host or own.get("host", "127.0.0.1"), a.port or own.get("port", 8080)).serve_forever()
    elif a.command == "detect-noise":
        table(noisy_directories(vault.scan(spark, vaults(config)), a.threshold))
    elif a.command in ("doctor", "support"):
        known = {"version": notes.store.version(), "kept": notes.store.versions(), "bytes": notes.store.size(), "spark": spark.version}
        places = {n: Path(f).is_dir() for n, f in vaults(config).items()}
        print(json.dumps(known | {"vaults": places} | ({"config": hidden(config), "files": {r.vault_name: r.n for r in notes.path_counts().collect()}} if a.command == "support" else {})))


if __name__ == "__main__":
    main()
