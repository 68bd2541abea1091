"""DuckDB SQL of the queries, each written from the definition and not from the Spark plan."""

from __future__ import annotations

_EV = """ev as (select event_id, user_id as video_id, epoch_us(ts) - epoch_us(timestamp '2024-01-01') as t, event_type, value,
            (list_position(['click','error','purchase','signup','view'], event_type) - 1)::int as token from events)"""
_TOK = _EV + """, tok as (select video_id, row_number() over (partition by video_id order by t, event_id) - 1 as pos, token from ev)"""
_RUN = _TOK + """, fl as (select *, coalesce((token <> lag(token) over (partition by video_id order by pos))::int, 0) as ch from tok),
    isl as (select *, sum(ch) over (partition by video_id order by pos rows unbounded preceding) as run_idx from fl),
    runs as (select video_id, run_idx::bigint as run_idx, min(token) as symbol, min(pos) as start, count(*) as length from isl group by video_id, run_idx)"""
_NAR = _EV + """, nar as (select event_id as id, video_id, t as start, t + round(value * 100)::bigint * 6000000 as stop, token as verb from ev)"""
_BND = _NAR + """, bnd as (select distinct video_id, t from (select video_id, unnest([start, stop]) as t from nar) where t > 0 and t < 720 * 3600000000)"""
_FEAT = """feat as (select vec_id // 50 as video_id, vec_id % 50 as clip_idx, (vec_id // 50) % 5 as participant, label as verb, embedding::double[] as v from embeddings)"""


def _match(keys: str, pairs: str) -> str:
    """Greedy matches of ``pairs`` (keys, d, i, j) as table m (keys, tp)."""
    return f"""m as (select {keys}, len(list_reduce(l, lambda a, x: case when list_contains(a.p, x.i) or list_contains(a.g, x.j) then a
        else {{'p': list_append(a.p, x.i), 'g': list_append(a.g, x.j)}} end, {{'p': []::bigint[], 'g': []::bigint[]}}).p)::bigint as tp
        from (select {keys}, list({{'i': i, 'j': j}} order by d, i, j) as l from {pairs} group by {keys}))"""


_SCORE = f"""with {_EV}, tols as (select unnest([3600000000, 10800000000, 21600000000]) as tol),
    p as (select video_id, t, row_number() over (partition by video_id order by t) - 1 as i from ev where event_type = 'purchase'),
    g as (select video_id, t, row_number() over (partition by video_id order by t) - 1 as j from ev where event_type = 'error'),
    c as (select p.video_id, tol, abs(p.t - g.t) as d, i, j from p join g using (video_id) join tols on abs(p.t - g.t) <= tol),
    {_match('video_id, tol', 'c')},
    s as (select v.video_id, tol, coalesce(np, 0) as n_pred, coalesce(ng, 0) as n_gt, coalesce(tp, 0) as tp
          from (select distinct video_id from ev) v cross join tols
          left join (select video_id, count(*) as np from p group by 1) using (video_id) left join (select video_id, count(*) as ng from g group by 1) using (video_id)
          left join m using (video_id, tol)),
    f as (select *, case when n_pred > 0 then tp / n_pred else 0 end as precision, case when n_gt > 0 then tp / n_gt else 0 end as recall from s)
"""
_F1 = "case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0 end"
_LAB = _NAR + """, grid as (select video_id, c as clip_idx, c * 3600000000 + 1800000000 as centre from (select distinct video_id from ev), range(720) r(c)),
    lab as (select g.video_id, g.clip_idx, coalesce(arg_max(n.verb, (n.start, n.stop, n.id)), -1) as label
            from grid g left join nar n on g.video_id = n.video_id and n.start <= g.centre and g.centre < n.stop group by all)"""
_COS = _FEAT + """, unit as (select video_id, clip_idx, list_transform(v, lambda x: x / (sqrt(list_dot_product(v, v)) + 1e-8)) as v from feat),
    ch as (select video_id, clip_idx, 1 - list_dot_product(v, lag(v) over w) as change from unit window w as (partition by video_id order by clip_idx))"""
_CODE = _FEAT + """, book as (select vec_id::int as code, embedding::double[] as c from embeddings where vec_id < 16),
    coded as (select video_id, clip_idx, arg_min(code, (d, code)) as code from (
        select video_id, clip_idx, code, list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as d from feat cross join book) group by 1, 2)"""
_MEAN = _FEAT + """, cell as (select video_id, clip_idx, participant, unnest(range(64)) as dim, unnest(v) as x from feat)"""
_PAIR = _RUN + """, seq as (select video_id, run_idx, symbol, start, lead(symbol) over (partition by video_id order by run_idx) as nxt from runs),
    pc as (select symbol as a, nxt as b, count(*) as n, min((video_id, run_idx)) as first from seq where nxt is not null group by 1, 2)"""
_LPT = """with recursive o as (select doc_id, coalesce(n_chars, 0)::bigint as weight, row_number() over (order by coalesce(n_chars, 0) desc, doc_id) as k from documents),
    w as (select list(weight order by k) as ws from o),
    step as (select 0::bigint as k, [0, 0, 0, 0, 0, 0, 0, 0]::bigint[] as totals, 0 as shard
             union all
             select k + 1, list_transform(totals, lambda x, i: case when i = list_position(totals, list_min(totals)) then x + ws[k + 1] else x end), list_position(totals, list_min(totals)) - 1
             from step, w where k < len(ws)),
    a as (select shard, doc_id, weight from step join o using (k) where k > 0)
"""


def _merge(only: str = "true") -> str:
    """Table h (step, video_id, sy, a, b, n): the sequences of the videos ``only`` after each merge; table top (m): the largest symbol before."""
    return f"""recursive_base as (select video_id, list({{'s': symbol, 'st': start}} order by run_idx) as sy from runs where {only} group by video_id),
    top as (select max(symbol) as m from runs),
    h as (select 0 as step, video_id, sy, null::int as a, null::int as b, null::bigint as n from recursive_base
          union all
          select step + 1, video_id, list_reduce(sy, lambda acc, x: case when len(acc) > 0 and acc[-1].s = p.a and x.s = p.b
                     then list_append(acc[1:len(acc) - 1], {{'s': m + step + 1, 'st': acc[-1].st}}) else list_append(acc, x) end, []::struct(s integer, st bigint)[]), p.a, p.b, p.n
          from h, top, (select x.s as a, y.s as b, count(*) as n from (select video_id, i, sy[i] as x, sy[i + 1] as y from (select video_id, sy, unnest(range(1, len(sy))) as i from h))
                        group by 1, 2 having count(*) >= 2 order by n desc, min((video_id, i)) limit 1) p
          where step < 64)"""


_LEVELS = "0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 11, 13, 16, 19, 23, 27, 32, 38, 45, 54, 64"


def _md5(*parts: str) -> str:
    return f"md5(concat_ws(':', {', '.join(f'({p})::varchar' for p in parts)}))"


def _drawn(keys: str, counts: str, trials: int) -> str:
    """Table dr (keys, trial, t): distinct random positions for ``counts`` (keys, n_pred, n_pos)."""
    parts = [x.strip() for x in keys.split(",")]
    return f"""dk as (select {keys}, trial, least(n_pred, n_pos - 1) as k, n_pos - 1 as most from {counts}, range({trials}) r(trial) where n_pred > 0 and n_pos > 1),
    d1 as (select {keys}, trial, k, ('0x' || substr({_md5('7', *parts, 'trial', 'j')}, 1, 8))::bigint % most + 1 as t, min(j) as j from (select *, unnest(range(2 * k + 40)) as j from dk where 4 * k <= most) group by {keys}, trial, k, t),
    d2 as (select {keys}, trial, t, k, row_number() over (partition by {keys}, trial order by {_md5('7', *parts, 'trial', 't')}, t) as r from (select *, unnest(range(1, most + 1)) as t from dk where 4 * k > most)),
    dr as (select {keys}, trial, t from (select *, row_number() over (partition by {keys}, trial order by j) as r from d1) where r <= k
           union all select {keys}, trial, t from d2 where r <= k)"""


def _report(meta: str, cps: str, tol: float) -> str:
    """Table rep (merges, n_videos, model_f1, random_f1, n_boundaries)."""
    return f"""with recursive {_RUN}, meta as (select video_id, {cps} as cps from (select distinct video_id from tok) where {meta}),
    gt as (select video_id, pos / cps as t, row_number() over (partition by video_id order by pos) - 1 as j from tok join meta using (video_id) where token = 1),
    el as (select video_id, n_pos, n_gt, cps from (select video_id, count(*) as n_pos from tok group by 1) join (select video_id, count(*) as n_gt from gt group by 1) using (video_id) join meta using (video_id) where n_pos >= 2),
    {_merge('video_id in (select video_id from el)')},
    got as (select step as merges from h where len(sy) > 1 group by 1),
    lv as (select step as merges, video_id, sy, n_pos, n_gt, cps, len(sy) - 1 as n_pred from h join el using (video_id) where step in ({_LEVELS}) and step in (select merges from got)),
    pm as (select merges, video_id, -1 as trial, sy[x].st / cps as t, x - 2 as i from (select *, unnest(range(2, len(sy) + 1)) as x from lv)),
    {_drawn('video_id, merges', 'lv', 20)},
    pr as (select merges, video_id, trial, t / cps as t, row_number() over (partition by merges, video_id, trial order by t) - 1 as i from dr join el using (video_id)),
    p as (select * from pm union all select * from pr),
    c as (select merges, p.video_id, trial, abs(p.t - gt.t) as d, i, j from p join gt on p.video_id = gt.video_id and abs(p.t - gt.t) <= {tol}),
    {_match('merges, video_id, trial', 'c')},
    f as (select merges, video_id, n_pred, case when n_pred > 0 then 2 * coalesce(a.tp, 0) / (n_pred + n_gt) else 0 end as model, case when n_pred > 0 then 2 * coalesce(b.tp, 0) / 20 / (n_pred + n_gt) else 0 end as chance
          from lv left join (select * from m where trial = -1) a using (merges, video_id) left join (select merges, video_id, sum(tp) as tp from m where trial >= 0 group by 1, 2) b using (merges, video_id)),
    rep as (select merges, count(*) as n_videos, avg(model) as model_f1, avg(chance) as random_f1, avg(n_pred) as n_boundaries from f group by 1)
"""


def _windows(stride: int) -> str:
    return f"select doc_id, (s // {stride})::int as clip_idx, s as start from (select doc_id, unnest(range(0, n_chars - 511, {stride})) as s from documents)"


ORACLES: dict[str, str] = {
    "boundary_f1_by_tolerance": f"{_SCORE} select video_id, tol, n_pred, n_gt, tp, round(precision, 6) as precision, round(recall, 6) as recall, round({_F1}, 6) as f1 from f",
    "boundary_macro_f1": f"{_SCORE} select tol, round(avg({_F1}), 6) as macro_f1 from f group by tol",
    "boundary_micro_f1": f"""{_SCORE}, q as (select tol, sum(tp)::bigint as tp, sum(n_pred)::bigint as n_pred, sum(n_gt)::bigint as n_gt from s group by tol),
        r as (select *, case when n_pred > 0 then tp / n_pred else 0 end as precision, case when n_gt > 0 then tp / n_gt else 0 end as recall from q)
        select tol, tp, n_pred, n_gt, round(precision, 6) as precision, round(recall, 6) as recall, round({_F1}, 6) as f1 from r""",
    "random_boundary_f1": f"""with {_EV}, vid as (select distinct video_id from ev),
        pr as (select video_id, count(distinct t // 3600000000) as n_pred, 720 as n_pos from ev where event_type = 'purchase' group by 1),
        gt as (select video_id, t, row_number() over (partition by video_id order by t) - 1 as j from (select distinct video_id, t // 3600000000 as t from ev where event_type = 'error')),
        ng as (select video_id, count(*) as n_gt from gt group by 1),
        {_drawn('video_id', 'pr', 200)},
        p as (select video_id, trial, t, row_number() over (partition by video_id, trial order by t) - 1 as i from dr),
        c as (select p.video_id, trial, abs(p.t - gt.t) as d, i, j from p join gt using (video_id) where abs(p.t - gt.t) <= 3),
        {_match('video_id, trial', 'c')},
        x as (select video_id, trial, coalesce(n_pred, 0) as n_pred, coalesce(n_gt, 0) as n_gt, coalesce(tp, 0) as tp from vid cross join range(200) a(trial)
              left join pr using (video_id) left join ng using (video_id) left join m using (video_id, trial))
        select video_id, max(n_pred) as n_pred, round(avg(case when tp > 0 then 2 * tp / (least(n_pred, 719) + n_gt) else 0 end), 6) as random_f1 from x group by 1""",
    "rle_runs": f"with {_RUN} select * from runs",
    "change_flags": f"with {_RUN} select video_id, pos, token, ch = 1 as changed from fl",
    "token_stats": f"""with {_RUN} select video_id, sum(length)::bigint as n_tokens, count(distinct symbol) as n_unique, 5 as codebook_size, count(*) - 1 as n_changes,
        round(avg(length), 6) as mean_run_length, max(length) as max_run_length from runs group by 1""",
    "mean_run_length": f"with {_RUN} select round(avg(m), 6) as mean_run_length, count(*) as n_videos from (select avg(length) as m from runs group by video_id)",
    "token_perplexity": f"with {_EV}, c as (select count(*) / (select count(*) from ev) as p from ev group by token) select round(exp(-sum(p * ln(p))), 6) as perplexity from c",
    "token_label_purity": """with c as (select o_orderstatus as a, o_orderpriority as b, count(*) as n from orders group by 1, 2)
        select round(sum(m) / sum(s), 6) as purity from (select max(n) as m, sum(n) as s from c group by a)""",
    "token_label_nmi": """with n as (select count(*) as t from orders), c as (select o_orderstatus as a, o_orderpriority as b, count(*) / t as p from orders, n group by 1, 2, t),
        a as (select a, sum(p) as p from c group by 1), b as (select b, sum(p) as p from c group by 1)
        select round((select sum(c.p * ln(c.p / (a.p * b.p))) from c join a using (a) join b using (b)) / (((select -sum(p * ln(p)) from a) + (select -sum(p * ln(p)) from b)) / 2), 6) as nmi""",
    "clip_windows_tumbling": _windows(512),
    "clip_windows_sliding": _windows(256),
    "clip_windows_gapped": _windows(768),
    "narration_boundaries": f"with {_BND} select * from bnd",
    "narration_boundaries_snapped": f"with {_BND} select distinct video_id, (t // 3600000000)::int as clip_idx from bnd where t // 3600000000 between 1 and 719",
    "clip_labels": f"with {_LAB} select video_id, clip_idx::int as clip_idx, label::int as label from lab",
    "clip_labels_unlabelled_signups": f"with {_LAB.replace('on g.video_id', 'on n.verb <> 3 and g.video_id')} select video_id, clip_idx::int as clip_idx, label::int as label from lab where label >= 0",
    "background_fraction": f"with {_LAB} select video_id, round(avg((label = -1)::int), 6) as background from lab group by 1",
    "top_labels": f"""with {_LAB}, n as (select video_id, label, count(*) as n from lab where label >= 0 group by 1, 2)
        select video_id, label::int as label, n, row_number() over (partition by video_id order by n desc, label desc)::int as rank from n qualify rank <= 5""",
    "l2_normalize": f"with {_COS} select video_id, clip_idx, unnest(range(64))::int as dim, round(unnest(v), 6) as x from unit",
    "transition_pairs": f"""with {_FEAT} select a.video_id, a.clip_idx, round(list_dot_product(a.v, b.v), 6) as cosine
        from feat a join feat b on a.video_id = b.video_id and b.clip_idx = a.clip_idx + 3""",
    "pair_concat": f"""with {_FEAT} select a.video_id, a.clip_idx, unnest(range(128))::int as dim, round(unnest(list_concat(a.v, b.v)), 6) as x
        from feat a join feat b on a.video_id = b.video_id and b.clip_idx = a.clip_idx + 3""",
    "copy_mse": f"""with {_FEAT}, e as (select list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as s
        from feat a join feat b on a.video_id = b.video_id and b.clip_idx = a.clip_idx + 3) select round(sum(s) / (64 * count(*)), 6) as copy_mse, count(*) as n_pairs from e""",
    "change_score": f"with {_COS} select video_id, clip_idx, round(change, 6) as change from ch where change is not null",
    "change_topk_boundaries": f"""with {_COS} select video_id, clip_idx, round(change, 6) as change from ch where change is not null
        qualify row_number() over (partition by video_id order by change desc, clip_idx desc) <= 5""",
    "video_mean": f"with {_MEAN} select video_id, dim::int as dim, round(avg(x), 6) as x from cell group by 1, 2",
    "video_residual": f"with {_MEAN} select video_id, clip_idx, dim::int as dim, round(x - avg(x) over (partition by video_id, dim), 6) as x from cell",
    "zscore_train_stats": f"with {_MEAN} select dim::int as dim, round(avg(x), 6) as mean, round(stddev_samp(x), 6) as sd from cell where participant <> 0 group by 1",
    "zscore_features": f"""with {_MEAN}, s as (select dim, avg(x) as m, stddev_samp(x) as sd from cell where participant <> 0 group by 1)
        select video_id, clip_idx, dim::int as dim, round((x - m) / (sd + 1e-6), 6) as x from cell join s using (dim)""",
    "nearest_code": f"with {_CODE} select video_id, clip_idx, code from coded",
    "code_usage": f"with {_CODE} select code, count(*) as n from coded group by 1",
    "code_perplexity": f"with {_CODE}, c as (select count(*) / (select count(*) from coded) as p from coded group by code) select round(exp(-sum(p * ln(p))), 6) as perplexity from c",
    "dead_codes": f"with {_CODE} select code from book where code not in (select code from coded)",
    "participant_codes": f"with {_FEAT} select participant, (row_number() over (order by min(video_id), participant) - 1)::int as code from feat where verb >= 0 group by 1",
    "verb_categories": f"with {_EV} select case token when 0 then 0 when 4 then 0 when 1 then 1 when 2 then 2 else -1 end as code, count(*) as n from ev group by 1",
    "heldout_video_split": f"""with v as (select distinct user_id as video_id, user_id % 5 as participant from events)
        select video_id, participant, row_number() over (partition by participant order by {_md5('7', 'video_id')}, video_id) <= greatest(1, floor(count(*) over (partition by participant) * 0.2::double)) as is_test from v""",
    "random_clip_split": f"with {_FEAT} select video_id, clip_idx, row_number() over (order by {_md5('7', 'video_id', 'clip_idx')}, video_id, clip_idx) <= floor(count(*) over () * 0.2::double) as is_test from feat",
    "random_event_split": f"select event_id, row_number() over (order by {_md5('7', 'event_id')}, event_id) <= floor(count(*) over () * 0.2::double) as is_test from events",
    "heldout_participant_split": f"with {_FEAT} select video_id, clip_idx, participant, participant in (1, 3) as is_test from feat",
    "train_videos": f"""with v as (select distinct user_id as video_id, user_id % 5 as participant from events)
        select video_id from v qualify row_number() over (partition by participant order by {_md5('7', 'video_id')}, video_id) > greatest(1, floor(count(*) over (partition by participant) * 0.2::double))""",
    "bpe_pair_counts": f"with {_PAIR} select a, b, n from pc",
    "bpe_first_merge": f"""with {_PAIR}, best as (select a, b from pc order by n desc, first limit 1),
        gone as (select video_id, run_idx + 1 as run_idx from seq, best where symbol = a and nxt = b)
        select s.video_id, s.start as pos from seq s anti join gone using (video_id, run_idx) where run_idx > 0""",
    "bpe_merges": f"with recursive {_RUN}, {_merge()} select distinct step, a, b, (m + step)::int as new, n from h, top where step > 0",
    "bpe_level_boundaries": f"with recursive {_RUN}, {_merge()} select step as merges, video_id, (len(sy) - 1)::bigint as n_boundaries from h where step in ({_LEVELS}) and len(sy) > 1",
    "bpe_level_report": f"{_report('video_id % 7 <> 6', '5.0::double * (1 + video_id % 2) / 10', 2.0)} select merges, n_videos, round(model_f1, 6) as model_f1, round(random_f1, 6) as random_f1, round(n_boundaries, 6) as n_boundaries from rep",
    "bpe_best_level": f"""{_report('true', '1.0::double', 1.0)} select merges, round(model_f1, 6) as model_f1, round(random_f1, 6) as random_f1, round(model_f1 - random_f1, 6) as gain
        from rep order by round(model_f1 - random_f1, 9) desc, merges limit 1""",
    "token_clip_purity": f"with {_LAB}, tok as (select video_id, row_number() over (partition by video_id order by t, event_id) - 1 as pos, token from ev), c as (select token, label, count(*) as n from tok join lab on tok.video_id = lab.video_id and pos = clip_idx where label >= 0 group by 1, 2) select round(sum(m) / sum(s), 6) as purity from (select max(n) as m, sum(n) as s from c group by token)",
    "labelled_features": f"with {_LAB}, {_FEAT} select feat.video_id, feat.clip_idx, label::int as label, round(v[1], 6) as x from feat join lab on feat.video_id = lab.video_id and feat.clip_idx = lab.clip_idx where label >= 0",
    "taxonomy_categories": """with t as (select n_nationkey as id, dense_rank() over (order by r_name) - 1 as code from nation join region on n_regionkey = r_regionkey where n_nationkey % 6 <> 5)
        select coalesce(code, -1)::int as code, count(*) as n from customer left join t on c_nationkey = id group by 1""",
    "video_codes": f"with {_EV} select video_id, (row_number() over (order by video_id) - 1)::int as code from (select distinct video_id from ev where event_type = 'purchase' and value > 60)",
    "annotated_videos": f"with {_EV} select distinct video_id from ev where event_type = 'signup' and value > 60",
    "lpt_shards": f"{_LPT} select shard::int as shard, doc_id, weight from a",
    "shard_spread": f"{_LPT} select count(*) as n_shards, min(t) as least, max(t) as most, max(t) - min(t) as spread from (select sum(weight)::bigint as t from a group by shard)",
    "pending_items": "select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_orderstatus = 'O' and o_orderpriority = '1-URGENT')",
    "macro_f1": """with p as (select l.quality as t, (d.n_chars >= 1500)::int as p from labels l join documents d using (doc_id)), c as (select t as y from p union select p from p)
        select round(avg(2 * (select count(*) from p where t = y and p = y) / ((select count(*) from p where t = y) + (select count(*) from p where p = y))), 6) as macro_f1, count(*) as n_classes from c""",
    "accuracy": "select round(avg((l.quality = (d.n_chars >= 1500)::int)::int), 6) as accuracy from labels l join documents d using (doc_id)",
    "topk_accuracy": f"""with {_FEAT}, s as (select video_id, clip_idx, verb, unnest(range(10)) as c, unnest(v[1:10]) as x from feat),
        r as (select *, row_number() over (partition by video_id, clip_idx order by x desc, c) as r from s)
        select round(avg(hit), 6) as top_k from (select max((c = verb and r <= 5)::int) as hit from r group by video_id, clip_idx)""",
    "majority_baseline": f"""with {_EV}, b as (select token from ev where video_id % 5 <> 0 group by token order by count(*) desc, token limit 1)
        select b.token as majority, round(avg((ev.token = b.token)::int), 6) as accuracy from ev, b where video_id % 5 = 0 group by 1""",
    "chance_baseline": f"with {_EV} select round(1 / (max(token) + 1), 6) as chance from ev",
}
