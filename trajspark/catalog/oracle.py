"""The same results in plain SQL for DuckDB, written without the engine's block and bracket devices."""

from __future__ import annotations

SEED = 42

# Fixed values below: the wording of the prompt (see operators/tasks.py).

# Order lines as frames, and their long form.
FRAMES = """
frames AS (
  SELECT l_orderkey AS episode_index,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey) - 1 AS frame_index,
         l_partkey AS task_index, l_quantity AS a0, l_extendedprice AS a1, l_discount AS a2, l_tax AS a3
  FROM lineitem),
long_frames AS (
  SELECT episode_index, frame_index, 0 AS dim, a0 AS x FROM frames UNION ALL
  SELECT episode_index, frame_index, 1, a1 FROM frames UNION ALL
  SELECT episode_index, frame_index, 2, a2 FROM frames UNION ALL
  SELECT episode_index, frame_index, 3, a3 FROM frames)
"""

BOUNDS = """
bounds AS (
  SELECT dim, quantile_cont(x, 0.01) AS lower, quantile_cont(x, 0.99) AS upper FROM long_frames GROUP BY dim)
"""

EVENTS = """
ev AS (
  SELECT event_id, user_id AS episode_index, value,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_index,
         count(*) OVER (PARTITION BY user_id) AS n
  FROM events)
"""

SPLITS = f"""
splits AS (
  SELECT o_orderkey AS episode_index,
         CASE WHEN row_number() OVER (ORDER BY md5('{SEED}:' || o_orderkey), o_orderkey) - 1
                   < trunc(CAST(0.8 AS DOUBLE) * (SELECT count(*) FROM orders))
              THEN 'train' ELSE 'val' END AS split
  FROM orders)
"""

TURNS = r"""
turns AS (
  SELECT conv_id AS sample, turn AS segment, role,
         list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') AS words,
         (1 + turn % 4) * (1 + conv_id % 4) AS cells, 2 * (1 + turn % 4) AS h, 2 * (1 + conv_id % 4) AS w
  FROM conversations),
token_turns AS (
  SELECT sample, segment, role,
         CASE WHEN role = 'user'
              THEN words || ['<vision_start>'] || list_transform(range(cells), lambda i: '<image>') || ['<vision_end>']
              ELSE words END AS tokens
  FROM turns),
tokens AS (
  SELECT sample, segment, token, CASE WHEN role = 'system' THEN 0 ELSE 1 END AS mask,
         row_number() OVER (PARTITION BY sample ORDER BY segment, i) - 1 AS pos
  FROM (SELECT sample, segment, role, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS i FROM token_turns))
"""

SEGMENTS = """
content AS (
  SELECT sample, segment * 4 + 1 AS segment, 'text' AS kind,
         len(words) + CASE WHEN role = 'user' THEN 1 ELSE 0 END AS slots, NULL AS gh, NULL AS gw FROM turns
  UNION ALL SELECT sample, segment * 4 + 2, 'image', cells, h // 2, w // 2 FROM turns WHERE role = 'user'
  UNION ALL SELECT sample, segment * 4 + 3, 'text', 1, NULL, NULL FROM turns WHERE role = 'user'),
lengths AS (
  SELECT sample, sum(slots) AS total, max(sum(slots)) OVER (PARTITION BY sample // 32) AS longest FROM content GROUP BY sample),
segments AS (
  SELECT *, CASE kind WHEN 'text' THEN slots WHEN 'image' THEN greatest(1, gh, gw) ELSE 0 END AS advance
  FROM (SELECT * FROM content UNION ALL
        SELECT sample, 0, 'pad', longest - total, NULL, NULL FROM lengths WHERE longest > total)),
placed AS (
  SELECT *, sum(advance) OVER win - advance AS p0, sum(slots) OVER win - slots AS s0
  FROM segments WINDOW win AS (PARTITION BY sample ORDER BY segment))
"""

VIDEO_SEGMENTS = """
shown AS (
  SELECT sample, segment, CASE WHEN kind = 'image' AND (segment // 4) % 2 = 1 THEN 'video' ELSE kind END AS kind,
         CASE WHEN kind = 'image' THEN 2 + (segment // 4) % 2 ELSE 1 END AS t, slots AS plane, gh, gw FROM content),
sized AS (
  SELECT *, t * plane AS slots, CASE kind WHEN 'text' THEN plane WHEN 'image' THEN greatest(t, gh, gw)
                                          ELSE t * greatest(1, gh, gw) END AS advance FROM shown),
seated AS (
  SELECT *, sum(advance) OVER win - advance AS p0, sum(slots) OVER win - slots AS s0
  FROM sized WINDOW win AS (PARTITION BY sample ORDER BY segment)),
cells_of AS (
  SELECT *, i // plane AS f, i % plane AS c, CASE kind WHEN 'video' THEN p0 + (i // plane) * greatest(1, gh, gw) ELSE p0 END AS q0
  FROM (SELECT *, unnest(range(CAST(slots AS BIGINT))) AS i FROM seated))
"""

VECTORS = """
cells AS (
  SELECT vec_id, label, (i - 1) // 8 AS step, (i - 1) % 8 AS dim, v
  FROM (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings)),
batches AS (
  SELECT vec_id, (row_number() OVER (ORDER BY md5('42:' || vec_id), vec_id) - 1) // 32 AS batch_id FROM embeddings),
errors AS (
  SELECT t.vec_id, t.label, b.batch_id, t.step, t.dim, t.v AS target, p.v AS predicted, p.v - t.v AS error
  FROM cells t
  JOIN cells p ON p.vec_id = (t.vec_id + 1) % (SELECT count(*) FROM embeddings) AND p.step = t.step AND p.dim = t.dim
  JOIN batches b ON b.vec_id = t.vec_id)
"""

POLICY = """
scored AS (
  SELECT vec_id, step, dim, v AS target, 0.5 * v + 0.5 * avg(v) OVER (PARTITION BY vec_id, step) AS predicted FROM cells)
"""

SHUFFLED = """
shuffled AS (
  SELECT event_id, value, row_number() OVER (ORDER BY md5('42:0:' || event_id), event_id) - 1 AS rank FROM events)
"""

TASKED = "(SELECT f.*, p_name AS task FROM frames f JOIN part ON p_partkey = f.task_index)"


def with_(*parts: str) -> str:
    return "WITH " + ", ".join(p.strip() for p in parts) + " "


def normalized(x: str) -> str:
    return f"2 * (least(greatest({x}, lower), upper) - lower) / (upper - lower + 1e-8) - 1"


def augmentation(epoch: int, position: str, only: str = "true", extra: str = "") -> str:
    return with_(EVENTS) + extra + f"""
      , drawn AS (
        SELECT episode_index, frame_index, number, transform,
               row_number() OVER (PARTITION BY episode_index, frame_index
                                  ORDER BY md5('42:{epoch}:' || episode_index || ':' || frame_index || ':' || transform)) AS r
        FROM ev, (VALUES (0, 'brightness'), (1, 'contrast'), (2, 'saturation'), (3, 'hue'), (4, 'sharpness')) t(number, transform))
      SELECT episode_index, frame_index,
             CAST(row_number() OVER (PARTITION BY episode_index, frame_index ORDER BY {position}) - 1 AS INTEGER) AS position, transform
      FROM drawn WHERE r <= 3 AND {only}"""


def repeated(position: str) -> str:
    return with_(TURNS) + f"""
      , images AS (
        SELECT sample, segment AS image_no, row_number() OVER (PARTITION BY sample ORDER BY segment) - 1 AS row,
               count(*) OVER (PARTITION BY sample) AS n
        FROM turns WHERE role = 'user')
      SELECT sample, image_no, repeat, {position} AS position FROM images, range(3) r(repeat)"""


def chunk_sql(extra: str, value: str, join: str = "", key: str = "e.event_id") -> str:
    return with_(EVENTS) + f"""{extra}
      SELECT {key}, CAST(s.step AS INTEGER) AS step, 0 AS dim, round({value}, 6) AS value
      FROM ev e CROSS JOIN range(8) s(step)
      JOIN ev f ON f.episode_index = e.episode_index AND f.frame_index = least(e.frame_index + s.step, e.n - 1) {join}"""


def epoch_sql(epoch: int) -> str:
    """(event_id, rank): the permutation of row numbers, walked until it is back among them."""

    def through(start: str) -> str:
        for number in range(4):
            noise = lambda half: f"('0x' || substr(md5('42:{epoch}:{number}:' || {half}), 1, 12))::BIGINT"  # noqa: B023, E731
            high, low = (f"(h + {noise('l')}) % high", "l") if number % 2 == 0 else ("h", f"(l + {noise('h')}) % low")
            start = f"SELECT event_id, n, high, low, {high} AS h, {low} AS l FROM ({start})"
        return f"SELECT event_id, n, high, low, h * low + l AS x FROM ({start})"

    halves = "event_id, n, high, low, x // low AS h, x % low AS l"
    return f"""
      WITH RECURSIVE size AS (
        SELECT n, high, (n + high - 1) // high AS low FROM (SELECT count(*) AS n, CAST(ceil(sqrt(count(*))) AS BIGINT) AS high FROM events)),
      numbered AS (SELECT event_id, n, high, low, row_number() OVER (ORDER BY event_id) - 1 AS x FROM events, size),
      walk AS (
        {through(f"SELECT {halves} FROM numbered")}
        UNION ALL {through(f"SELECT {halves} FROM walk WHERE x >= n")})
      SELECT event_id, x AS rank FROM walk WHERE x < n"""


ORACLE_SQL: dict[str, str] = {
    "scan_frames": """
      SELECT l_orderkey AS episode_index, l_partkey AS task_index, l_quantity AS a0, l_extendedprice AS a1,
             l_discount AS a2, l_tax AS a3 FROM lineitem""",
    "episode_summary": with_(FRAMES) + """
      SELECT episode_index, count(*) AS n_frames, min(frame_index) AS first_frame, max(frame_index) AS last_frame,
             count(DISTINCT task_index) AS n_tasks FROM frames GROUP BY episode_index""",
    "dataset_totals": """
      SELECT count(DISTINCT l_orderkey) AS total_episodes, count(*) AS total_frames FROM lineitem""",
    "saved_bounds": with_(FRAMES, BOUNDS) + "SELECT dim, round(lower, 6) AS lower, round(upper, 6) AS upper FROM bounds",
    "write_training_set": with_(FRAMES, SPLITS) + """
      SELECT split, rank // 32 AS batch_id, rank, episode_index, frame_index, task_index
      FROM (SELECT s.split, f.*, row_number() OVER (PARTITION BY s.split
                     ORDER BY md5('42:0:' || f.episode_index || ':' || f.frame_index), f.episode_index, f.frame_index) - 1 AS rank
            FROM frames f JOIN splits s ON s.episode_index = f.episode_index)""",
    "log_metrics": """
      SELECT CAST(epoch_us(ts) AS BIGINT) AS ts_micros, event_id AS step, event_type AS name, value FROM events""",
    "append_metrics": """
      SELECT CAST(epoch_us(ts) AS BIGINT) AS ts_micros, event_id AS step, event_type AS name, value FROM events""",
    "project_keys": with_(FRAMES) + "SELECT episode_index, frame_index, task_index FROM frames",
    "check_bounds": """
      SELECT l_partkey AS dim, max(l_discount) AS lower, max(l_tax) AS upper
      FROM lineitem GROUP BY l_partkey HAVING max(l_discount) > max(l_tax)""",
    "every_n": """
      SELECT event_id AS step, event_type, value FROM events
      WHERE (event_id + 1) % 10 = 0 OR event_id = (SELECT max(event_id) FROM events)""",
    "drop_padding": with_(TURNS) + "SELECT sample, pos, token FROM tokens WHERE mask = 1",
    "validate_chunks": "SELECT count(*) AS n_chunks, CAST(0 AS BIGINT) AS n_invalid FROM events",
    "select_episodes": with_(FRAMES, SPLITS) + """
      SELECT episode_index, frame_index, task_index FROM frames
      WHERE episode_index IN (SELECT episode_index FROM splits WHERE split = 'train')""",
    "attach_task": with_(FRAMES) + f"SELECT episode_index, frame_index, task_index, task FROM {TASKED}",
    "ordinal_join": with_(TURNS) + """
      , slots AS (
        SELECT sample, pos, row_number() OVER (PARTITION BY sample ORDER BY pos) AS ordinal FROM tokens WHERE token = '<image>'),
      features AS (
        SELECT sample, (sample * 31 + segment * 7 + cell) % (SELECT count(*) FROM embeddings) AS vec_id,
               row_number() OVER (PARTITION BY sample ORDER BY segment, cell) AS ordinal
        FROM (SELECT sample, segment, unnest(range(cells)) AS cell FROM turns WHERE role = 'user'))
      SELECT s.sample, s.pos, s.ordinal, f.vec_id, round(e.embedding[1]::DOUBLE, 6) AS value
      FROM slots s JOIN features f ON f.sample = s.sample AND f.ordinal = s.ordinal JOIN embeddings e ON e.vec_id = f.vec_id""",
    "prediction_error": with_(VECTORS) + f"""
      , box AS (SELECT dim, min(v) AS lower, max(v) AS upper FROM cells GROUP BY dim),
      restored AS (
        SELECT vec_id, step, e.dim,
               ({normalized('target')} + 1) * 0.5 * (upper - lower + 1e-8) + lower AS target,
               ({normalized('predicted')} + 1) * 0.5 * (upper - lower + 1e-8) + lower AS predicted
        FROM errors e JOIN box b ON b.dim = e.dim)
      SELECT vec_id, CAST(step AS INTEGER) AS step, CAST(dim AS INTEGER) AS dim, round(target, 6) AS target,
             round(predicted, 6) AS predicted, round(predicted - target, 6) AS error FROM restored""",
    "assign_segment": with_(TURNS) + "SELECT sample, pos, token, segment FROM tokens",
    "augmentation_plan": augmentation(0, "number"),
    "augmentation_plan_splits": augmentation(
        0, "number", "episode_index IN (SELECT episode_index FROM train)", """
      , users AS (SELECT DISTINCT user_id AS episode_index FROM events),
      train AS (
        SELECT episode_index FROM (SELECT episode_index, row_number() OVER (ORDER BY md5('42:' || episode_index), episode_index) AS r FROM users)
        WHERE r <= trunc(CAST(0.8 AS DOUBLE) * (SELECT count(*) FROM users)))"""),
    "augmentation_plan_random": augmentation(1, "r"),
    "fit_bounds": with_(FRAMES, BOUNDS) + "SELECT dim, round(lower, 6) AS lower, round(upper, 6) AS upper FROM bounds",
    "fit_bounds_train": with_(FRAMES, SPLITS) + """
      SELECT dim, round(quantile_cont(x, 0.01), 6) AS lower, round(quantile_cont(x, 0.99), 6) AS upper
      FROM long_frames WHERE episode_index IN (SELECT episode_index FROM splits WHERE split = 'train') GROUP BY dim""",
    "l1_loss": with_(VECTORS) + "SELECT round(avg(abs(error)), 6) AS l1_loss FROM errors",
    "validation_loss": with_(VECTORS) + """
      SELECT round(coalesce(avg(loss), 0), 6) AS val_loss, count(*) AS num_batches
      FROM (SELECT batch_id, avg(abs(error)) AS loss FROM errors GROUP BY batch_id)""",
    "error_profile": with_(VECTORS) + """
      SELECT CAST(step AS INTEGER) AS step, CAST(dim AS INTEGER) AS dim, label,
             CAST(grouping(step, dim, label) AS INTEGER) AS level, count(*) AS n,
             round(avg(target), 6) AS mean_target, round(avg(predicted), 6) AS mean_predicted,
             round(avg(abs(error)), 6) AS mean_abs_error, round(max(abs(error)), 6) AS max_abs_error
      FROM errors GROUP BY ROLLUP (step, dim, label)""",
    "error_quantiles": with_(VECTORS) + """
      , listed AS (
        SELECT step, dim, grouping(step, dim) AS level, count(*) AS n, list_sort(list(abs(error))) AS sorted
        FROM errors GROUP BY ROLLUP (step, dim))
      SELECT CAST(step AS INTEGER) AS step, CAST(dim AS INTEGER) AS dim, CAST(level AS INTEGER) AS level,
             round(sorted[CAST(ceil(0.5 * n) AS BIGINT)], 6) AS median_abs_error,
             round(sorted[CAST(ceil(0.95 * n) AS BIGINT)], 6) AS p95_abs_error FROM listed""",
    "bounds_from_stats": with_(FRAMES) + """
      SELECT CAST(dim AS INTEGER) AS dim, CAST(min(x) AS DOUBLE) AS lower, CAST(max(x) AS DOUBLE) AS upper FROM long_frames GROUP BY dim""",
    "refined_bounds": with_(FRAMES, BOUNDS) + "SELECT dim, round(lower, 6) AS lower, round(upper, 6) AS upper FROM bounds",
    "sketched_bounds": with_(FRAMES) + """
      SELECT dim, count(*) AS n_values, true AS lower_within, true AS upper_within FROM long_frames GROUP BY dim""",
    "grouped_l2_norm": with_(VECTORS) + """
      SELECT component, round(sqrt(sum(v * v)), 6) AS l2_norm, count(*) AS n_values FROM (
        SELECT 'label_' || label AS component, v FROM cells
        UNION ALL SELECT 'low_labels', v FROM cells WHERE label < 5
        UNION ALL SELECT 'global', v FROM cells) GROUP BY component""",
    "clip_by_global_norm": with_(VECTORS) + """
      SELECT vec_id, CAST(step * 8 + dim AS INTEGER) AS dim,
             round(v * least(1.0, 1.0 / ((SELECT sqrt(sum(v * v)) FROM cells) + 1e-6)), 9) AS value FROM cells""",
    "size_report": with_(FRAMES, SPLITS) + f"""
      SELECT split, task, CAST(grouping(split, task) AS INTEGER) AS level, count(DISTINCT f.episode_index) AS n_episodes,
             count(*) AS n_frames, 4 * count(*) AS n_elements, CAST(4 * count(*) FILTER (a0 > 25) AS BIGINT) AS n_flagged,
             CASE WHEN grouping(split, task) = 1
                  THEN CAST(ceil(count(*) / CASE split WHEN 'train' THEN 32 ELSE 128 END) AS BIGINT) END AS n_batches
      FROM {TASKED} f JOIN splits s ON s.episode_index = f.episode_index GROUP BY ROLLUP (split, task)""",
    "image_token_count": with_(TURNS) + """
      SELECT sample, count(*) AS n_images, CAST(sum(cells) AS BIGINT) AS n_tokens FROM turns WHERE role = 'user' GROUP BY sample""",
    "action_chunk": chunk_sql("", "f.value"),
    "action_chunk_small_blocks": chunk_sql("", "f.value"),
    "action_chunk_normalized": chunk_sql(
        ", bounds AS (SELECT quantile_cont(value, 0.01) AS lower, quantile_cont(value, 0.99) AS upper FROM events)",
        normalized("f.value"), "CROSS JOIN bounds"),
    "frame_index": with_(EVENTS) + "SELECT event_id, episode_index, frame_index FROM ev",
    "frame_index_many_ranges": with_(EVENTS) + "SELECT event_id, episode_index, frame_index FROM ev",
    "global_index": with_(FRAMES) + """
      SELECT episode_index, frame_index, row_number() OVER (ORDER BY episode_index, frame_index) - 1 AS index FROM frames""",
    "text_positions": with_(TURNS) + """
      SELECT sample, pos, mask, CASE WHEN mask = 0 THEN 1
        ELSE CAST(sum(mask) OVER (PARTITION BY sample ORDER BY pos) AS BIGINT) - 1 END AS position FROM tokens""",
    "position_deltas": with_(TURNS) + """
      SELECT sample, max(position) + 1 - count(*) AS delta, max(position) FILTER (mask = 1) + 1 - count(*) AS strict_delta
      FROM (SELECT sample, mask, CASE WHEN mask = 0 THEN 1
              ELSE CAST(sum(mask) OVER (PARTITION BY sample ORDER BY pos) AS BIGINT) - 1 END AS position FROM tokens)
      GROUP BY sample""",
    "grid_positions": with_(TURNS, SEGMENTS) + """
      SELECT sample, CAST(s0 + i AS BIGINT) AS slot, CASE kind WHEN 'pad' THEN 0 ELSE 1 END AS mask,
             CAST(CASE kind WHEN 'pad' THEN 1 WHEN 'text' THEN p0 + i ELSE p0 END AS BIGINT) AS pos_t,
             CAST(CASE kind WHEN 'pad' THEN 1 WHEN 'text' THEN p0 + i ELSE p0 + i // gw END AS BIGINT) AS pos_h,
             CAST(CASE kind WHEN 'pad' THEN 1 WHEN 'text' THEN p0 + i ELSE p0 + i % gw END AS BIGINT) AS pos_w
      FROM (SELECT *, unnest(range(CAST(slots AS BIGINT))) AS i FROM placed)""",
    "grid_positions_video": with_(TURNS, SEGMENTS, VIDEO_SEGMENTS) + """
      SELECT sample, CAST(s0 + i AS BIGINT) AS slot, 1 AS mask,
             CAST(CASE kind WHEN 'text' THEN p0 + i WHEN 'image' THEN p0 + f ELSE q0 END AS BIGINT) AS pos_t,
             CAST(CASE kind WHEN 'text' THEN p0 + i ELSE q0 + c // gw END AS BIGINT) AS pos_h,
             CAST(CASE kind WHEN 'text' THEN p0 + i ELSE q0 + c % gw END AS BIGINT) AS pos_w FROM cells_of""",
    "grid_deltas_video": with_(TURNS, SEGMENTS, VIDEO_SEGMENTS) + """
      SELECT sample, CAST(sum(advance) - sum(slots) AS BIGINT) AS delta FROM sized GROUP BY sample""",
    "grid_deltas": with_(TURNS, SEGMENTS) + """
      SELECT sample, CAST(sum(advance) - sum(slots) AS BIGINT) AS delta FROM segments GROUP BY sample""",
    "media_counts": with_(TURNS) + """
      SELECT sample, CAST(sum(CASE WHEN token = '<image>' AND prev = '<vision_start>' THEN 1 ELSE 0 END) AS BIGINT) AS n_images,
             CAST(sum(CASE WHEN token = '<video>' AND prev = '<vision_start>' THEN 1 ELSE 0 END) AS BIGINT) AS n_videos
      FROM (SELECT sample, token, coalesce(lag(token) OVER (PARTITION BY sample ORDER BY pos),
                     first_value(token) OVER (PARTITION BY sample ORDER BY pos DESC)) AS prev FROM tokens)
      GROUP BY sample""",
    "media_counts_video": with_(TURNS) + """
      SELECT sample, CAST(count(*) FILTER (role = 'user' AND segment % 2 = 0) AS BIGINT) AS n_images,
             CAST(count(*) FILTER (role = 'user' AND segment % 2 = 1) AS BIGINT) AS n_videos FROM turns GROUP BY sample""",
    "sequence_offsets_video": with_(TURNS) + """
      , frames_of AS (
        SELECT sample, segment, h * w AS area, unnest(range(1 + segment % 3)) AS f FROM turns WHERE role = 'user')
      SELECT CAST(0 AS BIGINT) AS entry, CAST(0 AS BIGINT) AS "offset" UNION ALL
      SELECT row_number() OVER win, CAST(sum(area) OVER win AS BIGINT) FROM frames_of WINDOW win AS (ORDER BY sample, segment, f)""",
    "sequence_offsets": with_(TURNS) + """
      SELECT CAST(0 AS BIGINT) AS entry, CAST(0 AS BIGINT) AS "offset" UNION ALL
      SELECT row_number() OVER win, CAST(sum(h * w) OVER win AS BIGINT) FROM turns WHERE role = 'user'
      WINDOW win AS (ORDER BY sample, segment)""",
    "seeded_rank": """
      SELECT o_orderkey AS episode_index, row_number() OVER (ORDER BY md5('42:' || o_orderkey), o_orderkey) - 1 AS rank FROM orders""",
    "split_episodes": with_(SPLITS) + "SELECT episode_index, split FROM splits",
    "epoch_order": f"SELECT a.event_id, a.rank AS rank_0, b.rank AS rank_1 FROM ({epoch_sql(0)}) a JOIN ({epoch_sql(1)}) b USING (event_id)",
    "epoch_batches": f"SELECT rank // 32 AS batch_id, rank, event_id FROM ({epoch_sql(0)})",
    "shuffle_epoch": """
      SELECT CAST(epoch AS INTEGER) AS epoch, event_id,
             row_number() OVER (PARTITION BY epoch ORDER BY md5('42:' || epoch || ':' || event_id), event_id) - 1 AS rank
      FROM events, range(2) r(epoch)""",
    "bounded_sample": """
      SELECT event_id, rank FROM (
        SELECT event_id, row_number() OVER (ORDER BY md5('42:' || event_id), event_id) - 1 AS rank FROM events) WHERE rank < 2048""",
    "assign_batches": with_(SHUFFLED) + "SELECT event_id, rank, rank // 32 AS batch_id FROM shuffled",
    "assign_batches_full_only": with_(SHUFFLED) + """
      SELECT event_id, rank, rank // 48 AS batch_id FROM shuffled WHERE rank // 48 < (SELECT count(*) FROM events) // 48""",
    "step_schedule": with_(SHUFFLED) + """
      , n AS (SELECT CAST(ceil(count(*) / 32) AS BIGINT) AS per_epoch FROM events),
      steps AS (SELECT unnest(range(CAST(floor(2.5 * per_epoch) AS BIGINT))) AS step, per_epoch FROM n),
      sizes AS (SELECT rank // 32 AS batch_id, count(*) AS n_samples FROM shuffled GROUP BY 1)
      SELECT step, step // per_epoch AS epoch, batch_id, n_samples, (step + 1) % 4 = 0 AS is_update,
             (step + 1) % 100 = 0 OR step + 1 = floor(2.5 * per_epoch) AS is_save
      FROM steps JOIN sizes ON batch_id = step % per_epoch""",
    "step_schedule_resumed": with_(SHUFFLED) + """
      , n AS (SELECT CAST(ceil(count(*) / 32) AS BIGINT) AS per_epoch FROM events),
      steps AS (SELECT unnest(range(CAST(floor(1.5 * per_epoch) AS BIGINT), CAST(floor(2.5 * per_epoch) AS BIGINT))) AS step, per_epoch FROM n),
      sizes AS (SELECT rank // 32 AS batch_id, count(*) AS n_samples FROM shuffled GROUP BY 1)
      SELECT step, step // per_epoch AS epoch, batch_id, n_samples, (step + 1) % 4 = 0 AS is_update,
             (step + 1) % 100 = 0 OR step + 1 = floor(2.5 * per_epoch) AS is_save
      FROM steps JOIN sizes ON batch_id = step % per_epoch""",
    "batch_preview": with_(SHUFFLED) + """
      SELECT batch_id, rank, event_id, value FROM (
        SELECT *, rank // 32 AS batch_id, row_number() OVER (PARTITION BY rank // 32 ORDER BY rank) AS nth FROM shuffled)
      WHERE nth <= 2""",
    "complement_episodes": with_(SPLITS) + """
      SELECT o_orderkey AS episode_index FROM orders EXCEPT SELECT episode_index FROM splits WHERE split = 'train'""",
    "normalize_actions": with_(FRAMES, BOUNDS) + f"""
      SELECT episode_index, frame_index, f.dim, round({normalized('x')}, 6) AS value
      FROM long_frames f JOIN bounds b ON b.dim = f.dim""",
    "unnormalize_actions": with_(FRAMES, BOUNDS) + f"""
      SELECT episode_index, frame_index, f.dim,
             round(({normalized('x')} + 1) * 0.5 * (upper - lower + 1e-8) + lower, 6) AS value
      FROM long_frames f JOIN bounds b ON b.dim = f.dim""",
    "normalize_chunks": with_(VECTORS) + f"""
      , box AS (SELECT dim, quantile_cont(v, 0.01) AS lower, quantile_cont(v, 0.99) AS upper FROM cells GROUP BY dim)
      SELECT vec_id, CAST(step AS INTEGER) AS step, CAST(c.dim AS INTEGER) AS dim, round({normalized('v')}, 6) AS value
      FROM cells c JOIN box b ON b.dim = c.dim""",
    "unnormalize_chunks": with_(VECTORS) + f"""
      , box AS (SELECT dim, quantile_cont(v, 0.01) AS lower, quantile_cont(v, 0.99) AS upper FROM cells GROUP BY dim)
      SELECT vec_id, CAST(step AS INTEGER) AS step, CAST(c.dim AS INTEGER) AS dim,
             round(({normalized('v')} + 1) * 0.5 * (upper - lower + 1e-8) + lower, 6) AS value
      FROM cells c JOIN box b ON b.dim = c.dim""",
    "render_prompt": with_(FRAMES) + f"""
      , named AS (SELECT *, episode_index || '/' || frame_index AS name FROM {TASKED})
      SELECT episode_index, frame_index, 0 AS part, 'text' AS type, 'Overview cam:' AS text, NULL AS image_ref FROM named
      UNION ALL SELECT episode_index, frame_index, 1, 'image', NULL, 'overview/' || name FROM named
      UNION ALL SELECT episode_index, frame_index, 2, 'text', 'Wrist cam:', NULL FROM named
      UNION ALL SELECT episode_index, frame_index, 3, 'image', NULL, 'wrist/' || name FROM named
      UNION ALL SELECT episode_index, frame_index, 4, 'text', 'What action should the robot take to ' || task || '?', NULL FROM named""",
    "format_actions": with_(VECTORS) + """
      SELECT vec_id, string_agg(line, chr(10) ORDER BY step) AS text FROM (
        SELECT vec_id, step, string_agg(printf('% .4f', v), ', ' ORDER BY dim) AS line FROM cells GROUP BY vec_id, step)
      GROUP BY vec_id""",
    "pad_left": with_(TURNS) + """
      , sized AS (SELECT *, max(len(words)) OVER (PARTITION BY sample) - len(words) AS gap FROM turns)
      SELECT sample, segment, CAST(pos AS INTEGER) AS pos,
             CASE WHEN pos < gap THEN 0 ELSE ('0x' || substr(md5(words[pos - gap + 1]), 1, 7))::BIGINT END AS token_id,
             CASE WHEN pos < gap THEN 0 ELSE 1 END AS mask
      FROM (SELECT *, unnest(range(gap + len(words))) AS pos FROM sized)""",
    "append_suffix": with_(TURNS) + """
      SELECT sample, segment, CAST(pos AS INTEGER) AS pos,
             CASE WHEN pos < len(words) THEN ('0x' || substr(md5(words[pos + 1]), 1, 7))::BIGINT ELSE 0 END AS token_id,
             1 AS mask, CASE WHEN pos < len(words) THEN pos ELSE 500 END AS position
      FROM (SELECT *, unnest(range(len(words) + 64)) AS pos FROM turns)""",
    "repeat_samples": repeated("row * 3 + repeat"),
    "repeat_sample_blocks": repeated("repeat * n + row"),
    "unstack_chunks": with_(VECTORS) + """
      SELECT vec_id, CAST(step AS INTEGER) AS step, CAST(dim AS INTEGER) AS dim, round(v, 6) AS value FROM cells""",
    "stack_chunks": "SELECT vec_id, CAST(step AS INTEGER) AS step, 8 AS n_dims, "
    + ", ".join(f"round(embedding[CAST(step * 8 + {i + 1} AS INTEGER)]::DOUBLE, 6) AS d{i}" for i in range(8))
    + " FROM embeddings, range(8) r(step)",
    "stream_normalize": f"""
      WITH bounds AS (SELECT quantile_cont(value, 0.01) AS lower, quantile_cont(value, 0.99) AS upper FROM events)
      SELECT event_id, round({normalized('value')}, 6) AS value FROM events CROSS JOIN bounds""",
    "stream_chunks": chunk_sql("", "f.value", key="e.episode_index, e.frame_index"),
    "stream_metrics_late": """
      WITH parts AS (SELECT event_id % 3 AS part, ts, event_type AS name, value, date_trunc('day', ts) AS start FROM events),
      marked AS (
        SELECT p.*, (SELECT max(q.ts) FROM parts q WHERE q.part < p.part) - INTERVAL 10 DAYS AS mark FROM parts p),
      judged AS (SELECT *, coalesce(start + INTERVAL 1 DAY <= mark, false) AS late FROM marked)
      SELECT CAST(epoch(start) AS BIGINT) AS start_seconds, name, round(avg(value) FILTER (NOT late), 6) AS mean_value,
             count(*) FILTER (NOT late) AS n, count(*) FILTER (late) AS n_late,
             CAST(coalesce(sum(epoch_us(mark) - epoch_us(ts)) FILTER (late), 0) AS BIGINT) AS delay_micros
      FROM judged GROUP BY 1, 2""",
    "stream_metrics": """
      SELECT CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS start_seconds, event_type AS name,
             round(avg(value), 6) AS mean_value, count(*) AS n FROM events GROUP BY 1, 2""",
    "score_policy": with_(VECTORS, POLICY) + """
      SELECT vec_id, CAST(step AS INTEGER) AS step, CAST(dim AS INTEGER) AS dim, round(predicted, 6) AS value FROM scored""",
    "evaluate_policy_loss": with_(VECTORS, POLICY) + """
      , ranked AS (SELECT vec_id, row_number() OVER (ORDER BY md5('42:' || vec_id), vec_id) - 1 AS rank FROM embeddings)
      SELECT round(coalesce(avg(loss), 0), 6) AS val_loss, count(*) AS num_batches FROM (
        SELECT rank // 128 AS batch_id, avg(abs(predicted - target)) AS loss
        FROM scored s JOIN ranked r ON r.vec_id = s.vec_id WHERE rank < 256 * 128 GROUP BY 1)""",
    "map_batches": with_(SHUFFLED) + """
      SELECT rank // 32 AS batch_id, count(*) AS n, round(avg(value), 8) AS mean_value FROM shuffled GROUP BY 1""",
    "training_set": with_(FRAMES, BOUNDS) + f"""
      , episodes AS (SELECT DISTINCT episode_index FROM frames),
      splits AS (
        SELECT episode_index, CASE WHEN row_number() OVER (ORDER BY md5('42:' || episode_index), episode_index) - 1
                 < trunc(CAST(0.8 AS DOUBLE) * (SELECT count(*) FROM episodes)) THEN 'train' ELSE 'val' END AS split FROM episodes),
      normal AS (
        SELECT f.*, s.split, ({normalized('a0').replace('lower', 'q.lower').replace('upper', 'q.upper')}) AS n0,
               ({normalized('a1').replace('lower', 'p.lower').replace('upper', 'p.upper')}) AS n1
        FROM frames f JOIN splits s ON s.episode_index = f.episode_index
        JOIN bounds q ON q.dim = 0 JOIN bounds p ON p.dim = 1),
      ranked AS (
        SELECT *, row_number() OVER (PARTITION BY split
                    ORDER BY md5('42:0:' || episode_index || ':' || frame_index), episode_index, frame_index) - 1 AS rank,
               last_value(n0) OVER ahead AS l0, last_value(n1) OVER ahead AS l1
        FROM normal
        WINDOW ahead AS (PARTITION BY episode_index ORDER BY frame_index ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING))
      SELECT split, CASE split WHEN 'train' THEN rank // 32 ELSE rank // 128 END AS batch_id, rank, episode_index, frame_index,
             p_name AS task, 'What action should the robot take to ' || p_name || '?' AS question, round(n1, 6) AS first_price, round(l1, 6) AS last_price,
             round(n0, 6) AS first_quantity, round(l0, 6) AS last_quantity
      FROM ranked JOIN part ON p_partkey = task_index""",
}
