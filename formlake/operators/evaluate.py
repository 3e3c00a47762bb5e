"""Evaluate one template over all submissions: values, conditions, visibility, tips, to-dos,
completeness and field validation.

The template (tens to hundreds of items) is collected once to the driver and compiled into
Column expressions; submissions are never collected. Conditions are added in dependency
levels (one ``withColumns`` per level), so every condition is computed once per row however
often it is referenced, and the whole evaluation is a single narrow stage over the
submissions: no shuffle, no Python UDF.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from formlake.functions.conditions import (InvalidExpressionError, Resolver, compile_condition,
                                           reference_target, references)
from formlake.functions.text import tip_severity, truthy
from formlake import schemas

MAX_TEMPLATE_ITEMS = 20000  # a template is configuration, not data


# ---------------------------------------------------------------------------
# Value item types. Each kind says how a stored answer becomes the item's value, when a
# reference to the item is "checked", and when the item counts as answered. Radios are
# exclusive within their container and are counted together by the completeness rule.
# ---------------------------------------------------------------------------
@dataclass(frozen=True)
class ItemKind:
    value: Callable[[Column, object], Column]
    checked: Callable[[Column, str], Column]
    answered: Callable[[Column], Column]
    exclusive: bool = False


def _checked_value(raw, it):
    return F.when(raw == "checked", F.lit("checked")).otherwise(F.lit(""))


def _text_value(raw, it):
    return F.coalesce(raw, F.lit(""))


def _upload_value(raw, it):
    parts = F.split(F.coalesce(raw, F.lit("")), r"\|")
    return F.when((F.size(parts) == 2) & (parts[0] != "") & (parts[1] != ""), raw).otherwise(F.lit(""))


def _never(v, ref):
    return F.lit(False)


def _always(v):
    return F.lit(True)


def _non_empty(v):
    return v != ""


ITEM_KINDS: dict[str, ItemKind] = {
    "check": ItemKind(_checked_value, lambda v, ref: v == "checked", _always),
    "radio": ItemKind(_checked_value, lambda v, ref: v == "checked", _always, exclusive=True),
    "yesno": ItemKind(lambda raw, it: F.when(raw.isin("yes", "no"), raw).otherwise(F.lit("")),
                      lambda v, ref: v == ref.rsplit("/", 1)[-1], _non_empty),
    "line": ItemKind(_text_value, _never, _non_empty),
    "box": ItemKind(_text_value, _never, _non_empty),
    "upload": ItemKind(_upload_value, _never, lambda v: F.split(v, r"\|")[0] != ""),
    "tip": ItemKind(lambda raw, it: raw if it.why else F.lit(None).cast("string"), _never, _always),
}


def register_item_type(name: str, kind: ItemKind) -> None:
    """Add a value item type (the template lint then accepts it as known)."""
    from formlake import schemas

    ITEM_KINDS[name] = kind
    for lst in (schemas.KNOWN_TYPES, schemas.VALUE_TYPES):
        if name not in lst:
            lst.append(name)


class TemplateError(ValueError):
    """The template cannot be evaluated (unknown reference, cycle, illegal operand)."""


@dataclass
class _Item:
    item_id: str
    idx: int
    type: str
    parent_id: str | None
    ancestors: list
    cond: str | None
    auth: str | None
    class_name: str | None
    default_value: str | None
    why: str | None
    warn: bool
    severity: str | None
    name: str | None
    todo: str | None
    text: str | None
    required: bool
    input_type: str | None
    input_pattern: str | None
    maxlength: int | None
    is_choice: bool


def load_items(items: DataFrame, template_id: str | None = None) -> list[Row]:
    """Collect the items of one template (bounded by ``MAX_TEMPLATE_ITEMS``)."""
    df = items if template_id is None else items.where(F.col("template_id") == template_id)
    rows = df.orderBy("ordinal").limit(MAX_TEMPLATE_ITEMS + 1).collect()
    if len(rows) > MAX_TEMPLATE_ITEMS:
        raise TemplateError(f"template has more than {MAX_TEMPLATE_ITEMS} items")
    return rows


class CompiledTemplate(Resolver):
    """Column builders for one flattened template.

    ``answers`` names a ``map<string,string>`` column of the submissions DataFrame.
    ``admin_mode`` shows admin-only blocks; ``unrolled`` shows every item regardless of
    its condition (both as in the reference's display modes).
    """

    def __init__(self, rows: list[Row], answers: str = "answers", admin_mode: bool = False,
                 unrolled: bool = False):
        self.answers = answers
        self.admin_mode = admin_mode
        self.unrolled = unrolled
        self.items: dict[str, _Item] = {}
        for i, r in enumerate(rows):
            d = r.asDict()
            self.items[d["item_id"]] = _Item(
                item_id=d["item_id"], idx=i, type=d["type"], parent_id=d["parent_id"],
                ancestors=list(d["ancestors"] or []), cond=d["cond"], auth=d["auth"],
                class_name=d["class_name"], default_value=d["default_value"], why=d["why"],
                warn=bool(d["warn"]), severity=d["severity"], name=d["name"], todo=d["todo"],
                text=d["text"], required=bool(d["required"]), input_type=d["input_type"],
                input_pattern=d["input_pattern"], maxlength=d["maxlength"], is_choice=bool(d["is_choice"]))
        self.order = list(self.items)
        self.children: dict[str, list[str]] = {}
        for it in self.items.values():
            if it.parent_id is not None:
                self.children.setdefault(it.parent_id, []).append(it.item_id)
        self._levels = self._dependency_levels()

    # -- names of the helper columns ------------------------------------------------
    prefix = ""

    def _cname(self, item_id: str) -> str:
        return f"__{self.prefix}cond_{self.items[item_id].idx}"

    def over(self, answers: str, prefix: str) -> CompiledTemplate:
        """The same template evaluated over another answers column (helper columns renamed)."""
        other = CompiledTemplate.__new__(CompiledTemplate)
        other.__dict__.update(self.__dict__)
        other.answers, other.prefix = answers, prefix
        return other

    # -- values (B13, B14) ------------------------------------------------------------
    def raw(self, item_id: str) -> Column:
        """Stored answer, or the template default when the key is absent."""
        it = self.items[item_id]
        a = F.col(self.answers)[item_id]
        return F.coalesce(a, F.lit(it.default_value)) if it.default_value is not None else a

    def value(self, name: str) -> Column | None:
        """String value of ``x/value`` references (None if ``name`` is not one)."""
        if "/value" not in name:
            return None
        tid = reference_target(name)
        it = self._item(tid)
        if it.type in ("block", "info", "spacer", "checkgroup", "radiogroup"):
            return None
        return self.item_value(tid)

    def item_value(self, item_id: str) -> Column:
        it = self.items[item_id]
        if it.type not in ITEM_KINDS:
            raise TemplateError(f"item {item_id} of type {it.type} has no value")
        return ITEM_KINDS[it.type].value(self.raw(item_id), it)

    def group_value(self, item_id: str) -> Column:
        """A group counts as answered when any of its choices has a value."""
        kids = [k for k in self.children.get(item_id, [])]
        if not kids:
            return F.lit(False)
        out = None
        for k in kids:
            v = truthy(self.item_value(k))
            out = v if out is None else (out | v)
        return out

    def is_checked(self, item_id: str, ref: str) -> Column:
        return ITEM_KINDS[self.items[item_id].type].checked(self.item_value(item_id), ref)

    # -- references (D6, D7) --------------------------------------------------------------
    def _item(self, tid: str) -> _Item:
        if tid not in self.items:
            raise TemplateError(f"condition refers to unknown item {tid!r}")
        return self.items[tid]

    def _cond_ref(self, item_id: str) -> Column:
        it = self.items[item_id]
        if not (it.cond or "").strip():
            return F.lit(True)
        return F.col(self._cname(item_id))

    def shown(self, item_id: str) -> Column:
        it = self.items[item_id]
        if (it.auth == "admin" and not self.admin_mode) or it.class_name == schemas.INVISIBLE_CLASS:
            return F.lit(False)
        return F.lit(True) if self.unrolled else self._cond_ref(item_id)

    def visible(self, item_id: str) -> Column:
        out = self.shown(item_id)
        for a in self.items[item_id].ancestors:
            if a in self.items:
                out = out & self.shown(a)
        return out

    def boolean(self, name: str) -> Column:
        if name == "false":
            return F.lit(False)
        tid = reference_target(name)
        it = self._item(tid)
        is_value_item = it.type in ITEM_KINDS
        if is_value_item and "/value" in name:
            return truthy(self.item_value(tid))
        if name.startswith("^"):
            return self.visible(tid)
        reach = self._cond_ref(tid)
        if it.parent_id is not None and it.parent_id in self.items:
            reach = self._cond_ref(it.parent_id) & reach
        if is_value_item:
            return reach & self.is_checked(tid, name)
        if it.type in ("checkgroup", "radiogroup"):
            return reach & self.group_value(tid)
        raise TemplateError(f"item {tid!r} of type {it.type} cannot be used in a condition")

    # -- dependency levels --------------------------------------------------------------
    def _cond_deps(self, item_id: str) -> set[str]:
        it = self.items[item_id]
        deps: set[str] = set()
        try:
            refs = references(it.cond)
        except InvalidExpressionError as e:
            raise TemplateError(f"item {item_id}: {e}") from None
        for ref in refs:
            if ref == "false":
                continue
            tid = reference_target(ref)
            t = self._item(tid)
            if "/value" in ref and t.type not in ("block", "info", "spacer", "checkgroup", "radiogroup"):
                continue
            if ref.startswith("^"):
                deps.update([tid] + [a for a in t.ancestors if a in self.items])
            else:
                deps.add(tid)
                if t.parent_id in self.items:
                    deps.add(t.parent_id)
        return {d for d in deps if (self.items[d].cond or "").strip()}

    def _dependency_levels(self) -> list[list[str]]:
        with_cond = [i for i in self.order if (self.items[i].cond or "").strip()]
        deps = {i: self._cond_deps(i) for i in with_cond}
        level: dict[str, int] = {}
        visiting: set[str] = set()

        def lvl(i: str) -> int:
            if i in level:
                return level[i]
            if i in visiting:
                raise TemplateError(f"conditions form a cycle through {i!r}")
            visiting.add(i)
            level[i] = 1 + max((lvl(d) for d in deps[i]), default=0)
            visiting.discard(i)
            return level[i]

        for i in with_cond:
            lvl(i)
        out: list[list[str]] = [[] for _ in range(max(level.values(), default=0))]
        for i in with_cond:
            out[level[i] - 1].append(i)
        return out

    # -- which answers a condition or an item's visibility depends on -------------------------
    def condition_keys(self) -> dict[str, set[str]]:
        """Per item with a condition, the answer keys it depends on, through other conditions too."""
        keys: dict[str, set[str]] = {}
        for items in self._levels:  # what an item depends on has a lower level
            for i in items:
                found: set[str] = set()
                for ref in references(self.items[i].cond):
                    target = reference_target(ref)
                    if ref == "false":
                        continue
                    if self.items[target].type in ITEM_KINDS:
                        if "/value" in ref or not ref.startswith("^"):
                            found.add(target)
                    elif not ref.startswith("^"):
                        found.update(self.children.get(target, []))
                keys[i] = found.union(*[keys[d] for d in self._cond_deps(i)])
        return keys

    def needed_conditions(self, item_id: str) -> set[str]:
        """The items whose conditions an item's visibility needs, directly or through others."""
        own = [a for a in (item_id, *self.items[item_id].ancestors) if a in self.items and (self.items[a].cond or "").strip()]
        needed: set[str] = set()
        while own:
            i = own.pop()
            if i not in needed:
                needed.add(i)
                own += self._cond_deps(i)
        return needed

    def visibility_keys(self) -> dict[str, set[str]]:
        """Per item, the answer keys that can show or hide it; items that no answer moves are left out."""
        keys = self.condition_keys()
        moved = {}
        for i in self.order:
            own = [a for a in (i, *self.items[i].ancestors) if a in keys]
            found = set().union(*[keys[a] for a in own])
            if found and not self.unrolled:
                moved[i] = found
        return moved

    # -- evaluation -------------------------------------------------------------------------
    def with_conditions(self, df: DataFrame, gate: Column | dict[str, Column] | None = None) -> DataFrame:
        """Add one boolean column per item condition, level by level (only where ``gate`` holds; a dict
        of gates adds only its items' conditions)."""
        for items in self._levels:
            cols = {}
            for i in items:
                if isinstance(gate, dict) and i not in gate:
                    continue
                try:
                    c = F.coalesce(compile_condition(self.items[i].cond, self), F.lit(False))
                except InvalidExpressionError as e:
                    raise TemplateError(f"item {i}: {e}") from None
                cols[self._cname(i)] = c if gate is None else F.when(gate[i] if isinstance(gate, dict) else gate, c)
            df = df.withColumns(cols) if cols else df
        return df

    def helper_columns(self) -> list[str]:
        return [self._cname(i) for lv in self._levels for i in lv]

    def answered(self, item_id: str) -> Column:
        return ITEM_KINDS[self.items[item_id].type].answered(self.item_value(item_id))

    def unanswered(self, block_id: str) -> Column:
        """Visible unanswered value items, recursively; direct radios count once if none checked."""
        total = F.lit(0)
        radios = []
        for k in self.children.get(block_id, []):
            it = self.items[k]
            if it.type in ITEM_KINDS and ITEM_KINDS[it.type].exclusive:
                radios.append(k)
            elif it.type in ITEM_KINDS:
                total = total + F.when(self.visible(k) & ~self.answered(k), 1).otherwise(0)
            elif it.type == "block":
                total = total + self.unanswered(k)
        if radios:
            any_checked = None
            for r in radios:
                c = self.item_value(r) == "checked"
                any_checked = c if any_checked is None else (any_checked | c)
            total = total + F.when(any_checked, 0).otherwise(1)
        return total

    # -- long-form outputs ----------------------------------------------------------------
    # output -> (struct builder, flag column: rows kept only where it is true, then dropped)
    OUTPUTS = {"item_visibility": ("_visibility_structs", None), "active_tips": ("_tip_structs", "visible"),
               "todo_list": ("_todo_structs", "visible"), "unanswered_counts": ("_unanswered_structs", None),
               "field_issues": ("_field_structs", "hit")}

    def _emit(self, df: DataFrame, keys: list[str], output: str, **kw) -> DataFrame:
        builder, flag = self.OUTPUTS[output]
        structs = getattr(self, builder)(**kw)
        if not structs:
            return df.limit(0).select(*keys)
        out = self.with_conditions(df).select(*keys, F.inline(F.array(*structs)))
        return out.where(flag).drop(flag) if flag else out

    def item_visibility(self, df: DataFrame, keys: list[str]) -> DataFrame:
        """(keys…, item_id, ordinal, shown, visible) for every item."""
        return self._emit(df, keys, "item_visibility")

    def active_tips(self, df: DataFrame, keys: list[str]) -> DataFrame:
        """Visible tips with warn flag, severity and name."""
        return self._emit(df, keys, "active_tips")

    def todo_list(self, df: DataFrame, keys: list[str]) -> DataFrame:
        """Visible tips with a to-do: key, description and the status stored under the key."""
        return self._emit(df, keys, "todo_list")

    def unanswered_counts(self, df: DataFrame, keys: list[str]) -> DataFrame:
        """I2 per block: (keys…, block_id, unanswered)."""
        return self._emit(df, keys, "unanswered_counts")

    def field_issues(self, df: DataFrame, keys: list[str], visible_only: bool = False) -> DataFrame:
        """C11-C14: (keys…, item_id, rule) for required, pattern, maxlength and input-type violations."""
        return self._emit(df, keys, "field_issues", visible_only=visible_only)

    def _visibility_structs(self) -> list[Column]:
        return [F.struct(F.lit(i).alias("item_id"), F.lit(self.items[i].idx).alias("ordinal"),
                         self.shown(i).alias("shown"), self.visible(i).alias("visible"))
                for i in self.order]

    def _tip_structs(self) -> list[Column]:
        tips = [i for i in self.order if self.items[i].type == "tip"]
        return [F.struct(F.lit(i).alias("item_id"), self.visible(i).alias("visible"),
                         F.lit(self.items[i].warn).alias("warn"),
                         tip_severity(F.lit(self.items[i].warn), F.lit(self.items[i].severity)).alias("severity"),
                         F.lit(self.items[i].name).cast("string").alias("name"))
                for i in tips]

    def _todo_structs(self) -> list[Column]:
        tips = [i for i in self.order if self.items[i].type == "tip" and (self.items[i].todo or "")]
        return [F.struct(F.lit(f"{schemas.TODO_KEY_PREFIX}{i}").alias("todo_key"), F.lit(self.items[i].idx).alias("ordinal"),
                         F.lit(self.items[i].todo).alias("description"),
                         F.col(self.answers)[f"{schemas.TODO_KEY_PREFIX}{i}"].alias("todo_status"),
                         self.visible(i).alias("visible"))
                for i in tips]

    def _unanswered_structs(self) -> list[Column]:
        blocks = [i for i in self.order if self.items[i].type == "block"]
        return [F.struct(F.lit(b).alias("block_id"), self.unanswered(b).cast("int").alias("unanswered"))
                for b in blocks]

    def _field_structs(self, visible_only: bool = False) -> list[Column]:
        structs = []
        for i in self.order:
            it = self.items[i]
            if it.type not in ("line", "box"):
                continue
            v = self.item_value(i)
            gate = self.visible(i) if visible_only else F.lit(True)
            if it.required:
                structs.append(F.struct(F.lit(i).alias("item_id"), F.lit("required_missing").alias("rule"),
                                        (gate & (v == "")).alias("hit")))
            if it.type == "line" and it.input_pattern:
                pat = f"^(?:{it.input_pattern})$"
                structs.append(F.struct(F.lit(i).alias("item_id"), F.lit("pattern_violation").alias("rule"),
                                        (gate & (v != "") & ~F.coalesce(F.rlike(v, F.lit(pat)), F.lit(False))).alias("hit")))
            if it.maxlength is not None:
                structs.append(F.struct(F.lit(i).alias("item_id"), F.lit("maxlength_violation").alias("rule"),
                                        (gate & (F.length(v) > F.lit(it.maxlength))).alias("hit")))
            if it.type == "line" and it.input_type:
                bad = _input_type_invalid(v, it.input_type)
                if bad is not None:
                    structs.append(F.struct(F.lit(i).alias("item_id"), F.lit("input_type_violation").alias("rule"),
                                            (gate & (v != "") & bad).alias("hit")))
        return structs


def _input_type_invalid(v: Column, input_type: str) -> Column | None:
    t = input_type.lower()
    if t == "date":
        return F.try_to_timestamp(v, F.lit("yyyy-MM-dd")).isNull()
    if t == "number":
        return v.try_cast("double").isNull()
    if t == "email":
        return ~v.rlike(r"^[^@\s]+@[^@\s]+$")
    if t == "url":
        return ~v.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://\S+$")
    return None


def compile_template(items: DataFrame, template_id: str | None = None, **kw) -> CompiledTemplate:
    return CompiledTemplate(load_items(items, template_id), **kw)


def evaluate_per_template(submissions: DataFrame, items: DataFrame, operator: str, keys: list[str],
                          template_col: str = "template_id", **kw) -> DataFrame:
    """D1 over many templates: one output (e.g. ``"active_tips"``) for submissions of any number of
    templates, each against its own (see ``bulk.evaluate_many``)."""
    from formlake.operators.bulk import evaluate_many

    out = evaluate_many(submissions.withColumnRenamed(template_col, "template_id"), items, operator, keys, **kw)
    return out.withColumnRenamed("template_id", template_col)
