"""Pieces of SQL shared by the checks."""


def inter(a: str, b: str) -> str:
    return (f"greatest(0.0, least({a}.x + {a}.w, {b}.x + {b}.w) - greatest({a}.x, {b}.x))"
            f" * greatest(0.0, least({a}.y + {a}.h, {b}.y + {b}.h) - greatest({a}.y, {b}.y))")


def iou(a: str, b: str) -> str:
    i = inter(a, b)
    u = f"({a}.w * {a}.h + {b}.w * {b}.h - {i})"
    return f"(CASE WHEN {u} <= 0 THEN 0.0 ELSE {i} / {u} END)"


def iou_eps(a: str, b: str) -> str:
    i = inter(a, b)
    return f"({i} / ({a}.w * {a}.h + {b}.w * {b}.h - {i} + 1e-6))"


def touch(a: str, b: str) -> str:
    return f"({a}.x < {b}.x + {b}.w AND {b}.x < {a}.x + {a}.w AND {a}.y < {b}.y + {b}.h AND {b}.y < {a}.y + {a}.h)"


def match(name: str, by_class: bool, t: float = 0.5, preds: str = "fx_predictions", config: str = "", pair_source: str | None = None) -> str:
    """CTEs ``<name>(<config>, image_id, pred_id, gt_id)``: greedy matching by recursion over score rank."""
    cfg = f"{config}, " if config else ""
    pcfg = f"p.{config}, " if config else ""
    key = f"{cfg}image_id" + (", category_id" if by_class else "")
    same = " AND p.category_id = g.category_id" if by_class else ""
    on = " AND ".join(f"c.{k.strip()} = m.{k.strip()}" for k in key.split(","))
    ckey = ", ".join(f"c.{k.strip()}" for k in key.split(","))
    pairs = pair_source or f"""
        SELECT {pcfg}p.image_id, p.category_id, p.pred_id, p.score, g.ann_id AS gt_id, {iou('p', 'g')} AS iou
        FROM {preds} p JOIN fx_annotations g ON p.image_id = g.image_id{same} AND {touch('p', 'g')}
        WHERE {iou('p', 'g')} >= {t}"""
    return f"""{name}_pairs AS ({pairs}),
    {name}_cand AS (
        SELECT {key}, pred_id, list(gt_id ORDER BY iou DESC, gt_id) AS gts,
               row_number() OVER (PARTITION BY {key} ORDER BY any_value(score) DESC, pred_id) AS rn
        FROM {name}_pairs GROUP BY {key}, pred_id),
    {name}_walk AS (
        SELECT DISTINCT {key}, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS pred_id, CAST(NULL AS BIGINT) AS gt_id, CAST([] AS BIGINT[]) AS used
        FROM {name}_cand
        UNION ALL
        SELECT {key}, rn, pred_id, pick, CASE WHEN pick IS NULL THEN used ELSE list_append(used, pick) END
        FROM (SELECT {ckey}, c.rn, c.pred_id, m.used, [g FOR g IN c.gts IF NOT list_contains(m.used, g)][1] AS pick
              FROM {name}_walk m JOIN {name}_cand c ON {on} AND c.rn = m.rn + 1)),
    {name} AS (SELECT {key}, pred_id, gt_id FROM {name}_walk WHERE gt_id IS NOT NULL)"""


def ap(name: str, flagged: str, truth: str, keys: str = "") -> str:
    """CTE ``<name>(<keys>, n_gt, ap)`` of ``flagged(<keys>, image_id, pred_id, score, tp)`` and ``truth(<keys>, n_gt)``."""
    part = f"PARTITION BY {keys} " if keys else ""
    k = f"{keys}, " if keys else ""
    joined = f"{flagged} JOIN {truth} USING ({keys})" if keys else f"{flagged} CROSS JOIN {truth}"
    back = f"{truth} LEFT JOIN {name}_ap USING ({keys})" if keys else f"{truth} LEFT JOIN {name}_ap ON true"
    return f"""{name}_curve AS (
        SELECT {k}CAST(sum(tp) OVER w AS DOUBLE) / row_number() OVER w AS precision, CAST(sum(tp) OVER w AS DOUBLE) / n_gt AS recall
        FROM {joined} WINDOW w AS ({part}ORDER BY score DESC, image_id, pred_id ROWS UNBOUNDED PRECEDING)),
    {name}_points AS (
        SELECT {k}i, max(CASE WHEN recall >= i * CAST(0.01 AS DOUBLE) THEN precision ELSE 0.0 END) AS p
        FROM {name}_curve CROSS JOIN range(0, 101) t(i) GROUP BY {k}i),
    {name}_ap AS (SELECT {k}sum(p) / 101 AS ap FROM {name}_points {'GROUP BY ' + keys if keys else ''}),
    {name} AS (SELECT {k}n_gt, coalesce(ap, 0.0) AS ap FROM {back})"""


def nms(name: str, preds: str, t: float, keys: str = "image_id, category_id") -> str:
    """CTE ``<name>(<keys>, pred_id)``: ids that suppression removes."""
    names = [k.strip() for k in keys.split(",")]
    on = " AND ".join(f"a.{k} = b.{k}" for k in names)
    step = " AND ".join(f"c.{k} = m.{k}" for k in names)
    akey, ckey = ", ".join(f"a.{k}" for k in names), ", ".join(f"c.{k}" for k in names)
    return f"""{name}_edges AS (
        SELECT {akey}, a.pred_id AS hi, a.score AS hs, b.pred_id AS lo, b.score AS ls
        FROM {preds} a JOIN {preds} b ON {on} AND (a.score > b.score OR (a.score = b.score AND a.pred_id < b.pred_id)) AND {touch('a', 'b')}
        WHERE {iou_eps('a', 'b')} > {t}),
    {name}_nodes AS (
        SELECT {keys}, pred_id, any_value(score) AS score, list(over) FILTER (over IS NOT NULL) AS above
        FROM (SELECT {keys}, lo AS pred_id, ls AS score, hi AS over FROM {name}_edges
              UNION ALL SELECT {keys}, hi, hs, NULL FROM {name}_edges) GROUP BY {keys}, pred_id),
    {name}_order AS (
        SELECT {keys}, pred_id, coalesce(above, CAST([] AS BIGINT[])) AS above,
               row_number() OVER (PARTITION BY {keys} ORDER BY score DESC, pred_id) AS rn FROM {name}_nodes),
    {name}_walk AS (
        SELECT DISTINCT {keys}, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS pred_id, false AS gone, CAST([] AS BIGINT[]) AS kept FROM {name}_order
        UNION ALL
        SELECT {keys}, rn, pred_id, gone, CASE WHEN gone THEN kept ELSE list_append(kept, pred_id) END
        FROM (SELECT {ckey}, c.rn, c.pred_id, m.kept, list_has_any(m.kept, c.above) AS gone
              FROM {name}_walk m JOIN {name}_order c ON {step} AND c.rn = m.rn + 1)),
    {name} AS (SELECT {keys}, pred_id FROM {name}_walk WHERE gone)"""


def fuse(name: str, preds: str, t: float, best_fit: bool, weight: str, source: str = "model_id") -> str:
    """CTE ``<name>(image_id, category_id, pred_id, c)``: clusters of sequential fusion, by recursion over rank."""
    near = "least(q.x + q.w, b.x + b.w) - greatest(q.x, b.x)", "least(q.y + q.h, b.y + b.h) - greatest(q.y, b.y)"
    i = f"(greatest(0.0, {near[0]}) * greatest(0.0, {near[1]}))".replace("b.", "")
    iou = f"({i} / (q.w * q.h + w * h - {i}))"
    pick = (f"CASE WHEN list_max([{iou} FOR q IN st]) > {t} THEN list_position([{iou} FOR q IN st], list_max([{iou} FOR q IN st])) END" if best_fit
            else f"list_position([{iou} >= {t} FOR q IN st], true)")
    first = "{'id': pred_id, 'x': x, 'y': y, 'w': w, 'h': h, 'sx': wt * x, 'sy': wt * y, 'sw': wt * w, 'sh': wt * h, 's': wt, 'n': 1, 'src': [src]}"
    mean = lambda c: f"CASE WHEN q.s + wt > 0 THEN (q.s{c} + wt * {c}) / (q.s + wt) ELSE q.{c} END"
    area = "WHERE w > 0 AND h > 0" if best_fit else ""
    grown = ("{'id': q.id, " + ", ".join(f"'{c}': {mean(c)}" for c in "xywh") + ", " + ", ".join(f"'s{c}': q.s{c} + wt * {c}" for c in "xywh")
             + ", 's': q.s + wt, 'n': q.n + 1, 'src': list_append(q.src, src)}")
    return f"""{name}_in AS (
        SELECT image_id, category_id, pred_id, {weight} AS wt, {source} AS src, x, y, w, h,
               row_number() OVER (PARTITION BY image_id, category_id ORDER BY {weight} DESC, pred_id) AS rn FROM {preds} {area}),
    {name}_walk AS (
        SELECT image_id, category_id, rn, [{first}] AS st FROM {name}_in WHERE rn = 1
        UNION ALL
        SELECT image_id, category_id, rn, CASE WHEN k IS NULL OR k = 0 THEN list_append(st, {first}) ELSE [CASE WHEN j = k THEN {grown} ELSE q END FOR q, j IN st] END
        FROM (SELECT *, {pick} AS k FROM (SELECT c.*, m.st FROM {name}_walk m JOIN {name}_in c ON c.image_id = m.image_id AND c.category_id = m.category_id AND c.rn = m.rn + 1))),
    {name} AS (
        SELECT image_id, category_id, c.id AS pred_id, c FROM (SELECT image_id, category_id, rn, unnest(st) AS c FROM {name}_walk)
        WHERE (image_id, category_id, rn) IN (SELECT image_id, category_id, max(rn) FROM {name}_in GROUP BY image_id, category_id))"""


def mixed(v: str, seed: int = 42) -> str:
    """The repeatable scatter of ``scalars.mixed``."""
    return f"CAST('0x' || left(md5('{seed}:' || CAST(({v}) AS BIGINT)), 8) AS BIGINT)"
