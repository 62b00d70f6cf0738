"""DuckDB twins of the queries: brute-force SQL over the same tables."""
from __future__ import annotations

ORACLES: dict[str, str] = {}

VIEWS = {
    "telemetry": """
        SELECT strftime(ts, '%Y-%m-%d') AS run_id, CAST(user_id % 10 AS INTEGER) AS robot_id, event_id, ts, event_type,
               value, ((value * 100) % 2000) / 100 - 10 AS odom_x, CAST(k % 20 - 10 AS DOUBLE) AS odom_y,
               sin(k / 100.0::DOUBLE * (2 * pi()) / 2) AS qz, cos(k / 100.0::DOUBLE * (2 * pi()) / 2) AS qw,
               CASE WHEN event_type = 'error' THEN 0.0 ELSE 0.15 END::DOUBLE AS cmd_speed, k
        FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k FROM events)""",
    "robots": """
        SELECT DISTINCT robot_id, robot_id * 0.5::DOUBLE AS spawn_x, robot_id * -0.25::DOUBLE AS spawn_y
        FROM telemetry WHERE robot_id < 8""",
    "world": """
        SELECT t.*, coalesce(spawn_x, 0) + odom_x AS x, coalesce(spawn_y, 0) + odom_y AS y
        FROM telemetry t LEFT JOIN robots USING (robot_id)""",
    "fleet": "SELECT DISTINCT run_id, robot_id FROM telemetry",
    "latest": """
        SELECT run_id, robot_id, x, y FROM world
        QUALIFY row_number() OVER (PARTITION BY run_id, robot_id ORDER BY ts DESC, event_id DESC) = 1""",
    "latest_pairs": """
        SELECT a.run_id, a.robot_id AS i, b.robot_id AS j, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS dist
        FROM latest a JOIN latest b ON a.run_id = b.run_id AND a.robot_id <> b.robot_id
        WHERE sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) < 3.0""",
    "messages": """
        SELECT run_id, event_id AS msg_id, ts, robot_id, k,
               '{"sender_id":' || robot_id || ',"graph":{"x":[[' || k || '.5,1.0],[0.25,' || robot_id
               || '.0]],"edge_index":[[0,1],[1,0]],"edge_type":[' || k || ',3],"num_nodes":2,"agent_id":' || robot_id
               || '}}' AS payload
        FROM telemetry WHERE event_type = 'purchase'""",
    "shares": "SELECT *, robot_id AS sender_id FROM messages WHERE msg_id % 50 <> 0",
    "asked": """
        SELECT s.run_id, s.msg_id, s.ts, s.sender_id, s.payload, f.robot_id FROM shares s JOIN fleet f USING (run_id)""",
    "placed": """
        SELECT a.*, w.x, w.y, w.ts AS seen FROM asked a
        ASOF JOIN world w ON a.run_id = w.run_id AND a.robot_id = w.robot_id AND a.ts >= w.ts""",
    "receivers": """
        SELECT p.run_id, p.msg_id, p.ts, p.sender_id, q.robot_id AS receiver_id,
               sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y)) AS dist
        FROM placed p JOIN placed q ON p.msg_id = q.msg_id AND p.robot_id = p.sender_id AND q.robot_id <> p.sender_id
        WHERE sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y)) < 3.0""",
    "cycle_merges": """
        SELECT run_id, CAST(hour(ts) AS INTEGER) AS cycle, sender_id, receiver_id, count(*) AS n FROM receivers GROUP BY ALL""",
    "running_pairs": """
        SELECT c.run_id, c.cycle, m.sender_id, m.receiver_id, CAST(sum(m.n) AS BIGINT) AS n_merges
        FROM cycles c JOIN cycle_merges m ON m.run_id = c.run_id AND m.cycle <= c.cycle GROUP BY ALL""",
    "pair_lists": """
        SELECT run_id, cycle,
               string_agg(sender_id || '-' || receiver_id || ':' || n_merges, ';' ORDER BY sender_id, receiver_id) AS csv_text,
               string_agg('(' || sender_id || ',' || receiver_id || ')×' || n_merges, '  ' ORDER BY sender_id, receiver_id) AS report_text
        FROM running_pairs GROUP BY ALL""",
    "cycles": """
        SELECT run_id, cycle, cycle * 3600 AS elapsed_sec,
               round(sum(s) OVER w / sum(n) OVER w, 9) AS mean_sim, CAST(sum(m) OVER w AS BIGINT) AS merges
        FROM (SELECT run_id, CAST(hour(ts) AS INTEGER) AS cycle, sum(value / 490.02::DOUBLE) AS s, count(*) AS n,
                     count(*) FILTER (WHERE event_type = 'purchase') AS m FROM telemetry GROUP BY ALL)
        WINDOW w AS (PARTITION BY run_id ORDER BY cycle)""",
    "risen": """
        SELECT *, first_value(mean_sim) OVER w AS baseline, lag(mean_sim) OVER w IS NOT NULL AS has_prev,
               coalesce(mean_sim - lag(mean_sim) OVER w, 0.0) AS delta,
               mean_sim - first_value(mean_sim) OVER w AS rise, row_number() OVER w AS pos
        FROM cycles WINDOW w AS (PARTITION BY run_id ORDER BY cycle)""",
    "steady": """
        SELECT *, pos - max(CASE WHEN NOT (has_prev AND abs(delta) < 0.005) THEN pos END)
                        OVER (PARTITION BY run_id ORDER BY cycle) AS stable FROM risen""",
    "judged": """
        SELECT *, bool_or(hit) OVER w AS converged,
               hit AND NOT coalesce(bool_or(hit) OVER (PARTITION BY run_id ORDER BY cycle ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS newly_converged
        FROM (SELECT *, merges > 0 AND rise >= 0.03 AND stable >= 3 AS hit FROM steady)
        WINDOW w AS (PARTITION BY run_id ORDER BY cycle)""",
    "runs": """
        SELECT DISTINCT run_id, CASE CAST(substr(run_id, 9, 2) AS INTEGER) % 3 WHEN 0 THEN 3 WHEN 1 THEN 5 ELSE 8 END AS n_robots,
               CAST(substr(run_id, 9, 2) AS INTEGER) // 3 AS seed FROM telemetry""",
    "ends": """
        SELECT run_id, robot_id, cycle, CAST(run_id AS TIMESTAMP) + INTERVAL 1 HOUR * (cycle + 1) AS ts
        FROM fleet, (SELECT CAST(range AS INTEGER) AS cycle FROM range(24))""",
    "cycle_positions": """
        SELECT e.*, w.x, w.y FROM ends e
        ASOF JOIN world w ON e.run_id = w.run_id AND e.robot_id = w.robot_id AND e.ts >= w.ts""",
    "cycle_pairs": """
        SELECT a.run_id, a.cycle, a.robot_id AS i, b.robot_id AS j,
               sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS dist
        FROM cycle_positions a JOIN cycle_positions b ON a.run_id = b.run_id AND a.cycle = b.cycle AND a.robot_id < b.robot_id
        WHERE sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) < 3.0""",
    "vectors": """
        SELECT vec_id // 10 AS run_id, vec_id AS agent_id, label, CAST(embedding AS DOUBLE[]) AS z FROM embeddings""",
    "agents": "SELECT label AS agent_id, arg_min(z, agent_id) AS z FROM vectors GROUP BY label",
    "beliefs": "SELECT run_id, robot_id, z FROM fleet JOIN agents ON robot_id = agent_id",
    "grids": """
        SELECT m AS map_id, CAST(pos AS INTEGER) AS cell, CAST(pos % 20 AS INTEGER) AS x, CAST(pos // 20 AS INTEGER) AS y,
               coalesce(CASE WHEN p_size % 5 = 0 THEN -1 ELSE 2 * p_size END, -1) AS v
        FROM (SELECT DISTINCT p_partkey // 200 AS m FROM part), (SELECT range AS pos FROM range(200))
        LEFT JOIN part ON p_partkey = m * 200 + pos""",
    "frontier": """
        SELECT c.map_id, c.cell, c.x, c.y FROM grids c
        WHERE c.v >= 0 AND c.v < 50 AND c.x BETWEEN 1 AND 18 AND c.y BETWEEN 1 AND 8
          AND EXISTS (FROM grids u WHERE u.map_id = c.map_id AND u.v = -1 AND abs(u.x - c.x) + abs(u.y - c.y) = 1)""",
    "reach": """
        SELECT map_id, cell, x, y, cell AS root FROM frontier
        UNION
        SELECT f.map_id, f.cell, f.x, f.y, r.root FROM reach r JOIN frontier f
        ON f.map_id = r.map_id AND abs(f.x - r.x) <= 1 AND abs(f.y - r.y) <= 1""",
    "clusters": "SELECT map_id, cell, x, y, min(root) AS cluster_id FROM reach GROUP BY ALL",
    "targets": """
        SELECT map_id, cluster_id, count(*) AS n_cells, -map_id + (avg(x) + 0.5::DOUBLE) * 0.05::DOUBLE AS tx,
               map_id + (avg(y) + 0.5::DOUBLE) * 0.05::DOUBLE AS ty
        FROM clusters GROUP BY map_id, cluster_id HAVING count(*) >= 4""",
    "usable": """
        SELECT * FROM targets
        WHERE sqrt((tx - (-map_id + 0.3::DOUBLE)) ** 2 + (ty - (map_id + 0.3::DOUBLE)) ** 2) >= 0.4""",
    "goal_log": """
        SELECT CAST(o_custkey % 10 AS INTEGER) AS robot_id, o_orderkey AS goal_num,
               o_orderdate + INTERVAL 1 SECOND * o_orderkey AS ts, (o_orderkey % 7) * 0.15::DOUBLE AS gx,
               (o_orderkey % 5) * 0.15::DOUBLE AS gy, (o_custkey % 3) * 0.06::DOUBLE AS step, o_orderstatus,
               floor(o_totalprice) % 150 AS took FROM orders""",
    "ordered_goals": "SELECT *, row_number() OVER (PARTITION BY robot_id ORDER BY ts, goal_num) AS pos FROM goal_log",
    "walk": """
        SELECT robot_id, goal_num, pos, gx AS lx, gy AS ly, true AS dispatched FROM ordered_goals WHERE pos = 1
        UNION ALL
        SELECT g.robot_id, g.goal_num, g.pos,
               CASE WHEN sqrt((g.gx - w.lx) * (g.gx - w.lx) + (g.gy - w.ly) * (g.gy - w.ly)) >= 0.2 THEN g.gx ELSE w.lx END,
               CASE WHEN sqrt((g.gx - w.lx) * (g.gx - w.lx) + (g.gy - w.ly) * (g.gy - w.ly)) >= 0.2 THEN g.gy ELSE w.ly END,
               sqrt((g.gx - w.lx) * (g.gx - w.lx) + (g.gy - w.ly) * (g.gy - w.ly)) >= 0.2
        FROM walk w JOIN ordered_goals g ON g.robot_id = w.robot_id AND g.pos = w.pos + 1""",
    "outcomes": """
        SELECT g.*, CASE WHEN NOT dispatched THEN 'resent' WHEN took > 120 THEN 'timed_out' WHEN o_orderstatus = 'P' THEN 'failed'
                         WHEN abs(gx - 1 + step - (gx - 1)) >= 0.1 THEN 'reached' ELSE 'no_motion' END AS outcome
        FROM goal_log g JOIN walk USING (robot_id, goal_num)""",
    "lines": """
        SELECT l_orderkey, l_partkey, l_suppkey, CAST(c_nationkey AS BIGINT) AS graph_id
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey""",
    "edges": """
        SELECT CAST(c_nationkey AS BIGINT) AS graph_id, c_custkey + 1000000000 AS src, CAST(c_nationkey AS BIGINT) AS dst, 1 AS etype FROM customer
        UNION ALL SELECT c_nationkey, o_orderkey + 2000000000, c_custkey + 1000000000, 3 FROM orders JOIN customer ON o_custkey = c_custkey
        UNION ALL SELECT DISTINCT graph_id, l_orderkey + 2000000000, l_partkey + 3000000000, 4 FROM lines
        UNION ALL SELECT DISTINCT graph_id, l_partkey + 3000000000, l_suppkey + 4000000000, 5 FROM lines""",
    "nodes": """
        SELECT graph_id, src AS node_id FROM edges UNION SELECT graph_id, dst FROM edges
        UNION SELECT s_nationkey, s_suppkey + 4000000000 FROM supplier""",
    "touches": """
        SELECT graph_id, src AS node_id, dst AS other, etype FROM edges
        UNION ALL SELECT graph_id, dst, src, etype FROM edges""",
    "relations": """
        SELECT graph_id, etype, -ln(count(*) / sum(count(*)) OVER (PARTITION BY graph_id)) AS info FROM edges GROUP BY graph_id, etype""",
    "raw_scores": """
        SELECT graph_id, node_id, count(t.etype) AS degree, ln(1 + count(t.etype)) AS weight, coalesce(avg(info), 0) AS surprise
        FROM nodes LEFT JOIN touches t USING (graph_id, node_id) LEFT JOIN relations r USING (graph_id, etype) GROUP BY graph_id, node_id""",
    "scores": """
        SELECT graph_id, node_id, degree, count(*) OVER g AS n,
               round((coalesce(weight / nullif(max(weight) OVER g, 0), 0) + coalesce(surprise / nullif(max(surprise) OVER g, 0), 0)) / 2, 9) AS score
        FROM raw_scores WINDOW g AS (PARTITION BY graph_id)""",
    "marked": """
        SELECT graph_id, node_id, row_number() OVER (PARTITION BY graph_id ORDER BY score DESC, node_id) <= ceil(0.4::DOUBLE * n) AS top FROM scores""",
    "inner_links": """
        SELECT t.graph_id, t.node_id, t.other FROM touches t JOIN marked a ON a.graph_id = t.graph_id AND a.node_id = t.node_id AND a.top
        JOIN marked b ON b.graph_id = t.graph_id AND b.node_id = t.other AND b.top""",
    "kept_parts(graph_id, node_id, part) USING KEY (graph_id, node_id)": """
        SELECT graph_id, node_id, node_id FROM marked WHERE top
        UNION
        SELECT u.graph_id, u.node_id, min(v.part) FROM recurring.kept_parts u
        JOIN inner_links l ON l.graph_id = u.graph_id AND l.node_id = u.node_id
        JOIN kept_parts v ON v.graph_id = l.graph_id AND v.node_id = l.other
        WHERE v.part < u.part GROUP BY ALL""",
    "bridges": """
        SELECT t.graph_id, t.node_id FROM touches t JOIN marked m ON m.graph_id = t.graph_id AND m.node_id = t.node_id AND NOT m.top
        JOIN kept_parts p ON p.graph_id = t.graph_id AND p.node_id = t.other GROUP BY ALL HAVING count(DISTINCT part) > 1""",
    "kept": "SELECT graph_id, node_id FROM marked WHERE top UNION ALL SELECT graph_id, node_id FROM bridges",
    "contact_reach": """
        SELECT run_id, cycle, robot_id, robot_id AS root FROM cycle_positions
        UNION
        SELECT r.run_id, r.cycle, CASE WHEN p.i = r.robot_id THEN p.j ELSE p.i END, r.root
        FROM contact_reach r JOIN cycle_pairs p ON p.run_id = r.run_id AND p.cycle = r.cycle AND (p.i = r.robot_id OR p.j = r.robot_id)""",
    "union_reach": """
        SELECT run_id, "at", robot_id, robot_id AS root FROM fleet, (VALUES (5), (11), (17), (23)) t("at")
        UNION
        SELECT r.run_id, r."at", CASE WHEN p.i = r.robot_id THEN p.j ELSE p.i END, r.root
        FROM union_reach r JOIN cycle_pairs p ON p.run_id = r.run_id AND p.cycle <= r."at" AND (p.i = r.robot_id OR p.j = r.robot_id)""",
    "hour_reach": """
        SELECT run_id, "at", robot_id, robot_id AS root FROM fleet, (SELECT CAST(range AS INTEGER) AS "at" FROM range(24))
        UNION
        SELECT r.run_id, r."at", CASE WHEN p.i = r.robot_id THEN p.j ELSE p.i END, r.root
        FROM hour_reach r JOIN cycle_pairs p ON p.run_id = r.run_id AND p.cycle <= r."at" AND (p.i = r.robot_id OR p.j = r.robot_id)""",
    "end_reach": """
        SELECT run_id, robot_id, robot_id AS root FROM latest
        UNION
        SELECT r.run_id, p.j, r.root FROM end_reach r JOIN latest_pairs p ON p.run_id = r.run_id AND p.i = r.robot_id""",
    "end_parts": "SELECT run_id, robot_id, min(root) AS component FROM end_reach GROUP BY ALL",
    "folds": """
        SELECT a.agent_id, len(s) AS n_folded,
               list_reduce(list_prepend(a.z, s), lambda z, r: list_transform(
                   list_transform(z, lambda v, i: 0.7::DOUBLE * v + 0.3::DOUBLE * r[i]), lambda v: v / greatest(1e-8::DOUBLE, sqrt(
                   list_sum(list_transform(z, lambda v, i: (0.7::DOUBLE * v + 0.3::DOUBLE * r[i]) ** 2)))))) AS z
        FROM agents a JOIN (SELECT label, list(z ORDER BY agent_id) AS s FROM vectors GROUP BY label) ON label = a.agent_id""",
    "stuck_rows": "SELECT run_id, robot_id, ts, event_id, event_type, x, y, cmd_speed AS speed FROM world",
    "hour_cycles": """
        SELECT run_id, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS ts, arg_max(value / 490.02::DOUBLE, ts) AS mean_sim,
               count(*) FILTER (WHERE event_type = 'purchase') AS merges
        FROM telemetry GROUP BY 1, 2 HAVING time_bucket(INTERVAL 1 HOUR, telemetry.ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 1 MINUTE FROM telemetry)""",
    "monitor": """
        SELECT c.run_id, c.cycle, c.n_agents, c.mean_sim,
               CAST(coalesce((SELECT sum(n) FROM cycle_merges m WHERE m.run_id = c.run_id AND m.cycle <= c.cycle), 0) AS BIGINT) AS merges
        FROM (SELECT a.run_id, a.cycle, CAST(count(DISTINCT a.robot_id) AS BIGINT) AS n_agents,
                     coalesce(avg(list_cosine_similarity(a.z, b.z)) FILTER (WHERE a.robot_id <> b.robot_id), 0) AS mean_sim
              FROM active a JOIN active b ON a.run_id = b.run_id AND a.cycle = b.cycle GROUP BY ALL) c""",
    "active": """
        SELECT DISTINCT run_id, CAST(hour(ts) AS INTEGER) AS cycle, robot_id, z FROM telemetry JOIN agents ON robot_id = agent_id""",
}
# Of equal times the largest event counts.
VIEWS["closed_cycles"] = VIEWS["hour_cycles"].replace("490.02::DOUBLE, ts)", "490.02::DOUBLE, row(ts, event_id))")
VIEWS["instants"] = "SELECT * FROM world QUALIFY row_number() OVER (PARTITION BY run_id, robot_id, ts ORDER BY event_id DESC) = 1"
VIEWS["placed_last"] = VIEWS["placed"].replace("JOIN world", "JOIN instants")
VIEWS["heard"] = VIEWS["receivers"].replace("placed p JOIN placed q", "placed_last p JOIN placed_last q")
# What each view reads.
NEEDS = {
    "robots": ["telemetry"], "world": ["robots"], "fleet": ["telemetry"], "latest": ["world"], "latest_pairs": ["latest"],
    "messages": ["telemetry"], "shares": ["messages"], "asked": ["shares", "fleet"], "placed": ["asked", "world"],
    "receivers": ["placed"], "cycle_merges": ["receivers"], "running_pairs": ["cycle_merges", "cycles"], "pair_lists": ["running_pairs"],
    "cycles": ["telemetry"], "risen": ["cycles"], "steady": ["risen"], "judged": ["steady"], "runs": ["telemetry"],
    "ends": ["fleet"], "cycle_positions": ["ends", "world"], "cycle_pairs": ["cycle_positions"], "agents": ["vectors"],
    "beliefs": ["fleet", "agents"], "frontier": ["grids"], "reach": ["frontier"], "clusters": ["reach"], "targets": ["clusters"],
    "usable": ["targets"], "ordered_goals": ["goal_log"], "walk": ["ordered_goals"], "outcomes": ["goal_log", "walk"],
    "edges": ["lines"], "nodes": ["edges"], "touches": ["edges"], "relations": ["edges"],
    "marked": ["scores"], "inner_links": ["touches", "marked"], "kept_parts(graph_id, node_id, part) USING KEY (graph_id, node_id)": ["inner_links"],
    "bridges": ["kept_parts(graph_id, node_id, part) USING KEY (graph_id, node_id)"], "kept": ["bridges"],
    "raw_scores": ["nodes", "touches", "relations"], "scores": ["raw_scores"], "contact_reach": ["cycle_pairs"],
    "union_reach": ["cycle_pairs", "fleet"], "hour_reach": ["cycle_pairs", "fleet"], "end_reach": ["latest_pairs"], "end_parts": ["end_reach"], "folds": ["agents"],
    "stuck_rows": ["world"], "hour_cycles": ["telemetry"], "closed_cycles": ["telemetry"], "instants": ["world"],
    "placed_last": ["asked", "instants"], "heard": ["placed_last"], "active": ["telemetry", "agents"],
    "monitor": ["active", "cycle_merges"],
}


def oracle(name: str, views: str, body: str) -> None:
    found: list[str] = []

    def add(view):
        for need in NEEDS.get(view, []):
            add(need)
        if view not in found:
            found.append(view)

    for view in views.split():
        add(view)
    head = ", ".join(f"{v} AS ({VIEWS[v]})" for v in found)
    ORACLES[name] = f"WITH RECURSIVE {head} {body}" if head else body


def stuck_sql(rows: str, cleared: bool) -> str:
    """Brute force over the samples of each tick's robot."""
    clear = f"(SELECT max(c.ts) FROM {rows} c WHERE c.run_id = k.run_id AND c.robot_id = k.robot_id AND c.event_type = 'signup' AND c.ts < k.tick)"
    return f"""
        ticks AS (SELECT run_id, robot_id, event_id, ts + INTERVAL 45 MINUTE AS tick FROM {rows} WHERE event_type IN ('click', 'view')),
        bounded AS (SELECT k.*, {clear if cleared else 'NULL::TIMESTAMP'} AS since FROM ticks k),
        newest AS (SELECT b.run_id, b.robot_id, b.event_id, b.tick, b.since, max(s.ts) AS last, max(s.ts) FILTER (WHERE b.since IS NULL OR s.ts > b.since) AS fresh,
                          arg_max(s.x, s.ts) AS hx, arg_max(s.y, s.ts) AS hy
                   FROM bounded b JOIN {rows} s ON s.run_id = b.run_id AND s.robot_id = b.robot_id AND s.ts <= b.tick GROUP BY ALL),
        verdict AS (SELECT n.run_id, n.robot_id, n.event_id, n.tick, coalesce(count(s.ts) >= 2 AND n.tick - min(s.ts) >= INTERVAL 4 HOUR AND min(s.speed) > 0
                           AND sqrt((n.hx - arg_min(s.x, s.ts)) ** 2 + (n.hy - arg_min(s.y, s.ts)) ** 2) < 6.0, false) AS stuck
                    FROM newest n LEFT JOIN {rows} s ON s.run_id = n.run_id AND s.robot_id = n.robot_id AND s.ts <= n.fresh
                         AND s.ts >= n.fresh - INTERVAL 4 HOUR AND (n.since IS NULL OR s.ts > n.since)
                    GROUP BY n.run_id, n.robot_id, n.event_id, n.tick, n.hx, n.hy)"""


SIM = "(value / 245.01::DOUBLE - 1)"
YAW = "atan2(2.0 * (qw * qz), 1.0 - 2.0 * (qz * qz))"
TREND = "CASE WHEN delta > 0.005 THEN '↑ converging' WHEN delta < -0.005 THEN '↓ diverging' ELSE '→ stable' END"
MEAN_PAIRS = """coalesce(avg(list_cosine_similarity(a.z, b.z)) FILTER (WHERE a.agent_id <> b.agent_id), 0)"""

oracle("telemetry_source", "telemetry", """SELECT run_id, robot_id, event_id, epoch_us(ts) AS us, round(odom_x, 6) AS odom_x,
    round(odom_y, 6) AS odom_y, round(qz, 6) AS qz, round(qw, 6) AS qw, cmd_speed FROM telemetry""")
oracle("share_messages", "shares", "SELECT run_id, msg_id, epoch_us(ts) AS us, sender_id, 2 AS num_nodes FROM shares")
oracle("share_rejects", "messages", """SELECT run_id, msg_id, substr(payload, 1, 12) AS payload, 'malformed message' AS error
    FROM messages WHERE msg_id % 50 = 0""")
oracle("share_filter", "shares fleet", """SELECT s.run_id, sender_id, count(DISTINCT msg_id) AS n_shares, count(DISTINCT f.robot_id) AS n_others
    FROM shares s JOIN fleet f ON f.run_id = s.run_id AND f.robot_id <> s.sender_id GROUP BY ALL""")
oracle("grid_to_cells", "grids", "SELECT map_id, CAST(0 AS BIGINT) AS seq, CAST(cell AS BIGINT) AS cell, x, y, v FROM grids")
oracle("graph_assignment", "", """SELECT vec_id AS agent_id, vec_id * 900 AS ds_idx, p_partkey AS graph_id FROM embeddings
    JOIN (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS idx, count(*) OVER () AS n FROM part) ON vec_id * 900 % n = idx""")
oracle("cycle_csv_rows", "judged cycle_positions pair_lists", f"""SELECT j.run_id, j.cycle,
    strftime(CAST(j.run_id AS TIMESTAMP) + INTERVAL 1 HOUR * j.cycle, '%Y-%m-%dT%H:%M:%S.%f') AS "timestamp", CAST(elapsed_sec AS BIGINT) AS elapsed_sec,
    round(mean_sim, 6) AS mean_sim, round(baseline, 6) AS baseline, round(rise, 6) AS rise,
    CASE WHEN converged THEN 'True' ELSE 'False' END AS converged,
    {', '.join(f"(SELECT round(p.{a}, 6) FROM cycle_positions p WHERE p.run_id = j.run_id AND p.cycle = j.cycle AND p.robot_id = {i}) AS robot{i}_{a}" for i in range(10) for a in 'xy')},
    coalesce(csv_text, '') AS pair_counts FROM judged j LEFT JOIN pair_lists USING (run_id, cycle)""")
oracle("convergence_feed", "telemetry", """SELECT run_id, epoch_us(ts) AS us, round(CAST(CAST(value / 490.02::DOUBLE AS FLOAT) AS DOUBLE), 4) AS mean_sim FROM telemetry""")
oracle("request_verdicts", "telemetry", """SELECT event_id, error = '' AS ok, nullif(error, '') AS error FROM (SELECT event_id,
    concat_ws('; ', CASE WHEN k % 12 >= 10 THEN 'unknown agent' END, CASE WHEN k % 12 = robot_id THEN 'self merge' END,
              CASE WHEN value > 400 THEN 'weight out of range' END) AS error FROM telemetry)""")
oracle("markers", "latest_pairs beliefs cycles", """
    , means AS (SELECT a.run_id, a.robot_id, coalesce(avg(list_cosine_similarity(a.z, b.z)) FILTER (WHERE a.robot_id <> b.robot_id), 0) AS m
                FROM beliefs a JOIN beliefs b USING (run_id) GROUP BY ALL),
      placed_robots AS (SELECT l.run_id, robot_id, x, y, m, greatest(0, least(1, (m + 1) / 2)) AS g,
                               2 * (row_number() OVER (PARTITION BY l.run_id ORDER BY robot_id) - 1) AS id FROM latest l JOIN means USING (run_id, robot_id)),
      sizes AS (SELECT run_id, 2 * count(*) AS n FROM latest GROUP BY run_id),
      links AS (SELECT p.run_id, n + row_number() OVER (PARTITION BY p.run_id ORDER BY i, j) - 1 AS id, a.x, a.y, b.x AS x2, b.y AS y2
                FROM latest_pairs p JOIN sizes USING (run_id) JOIN latest a ON a.run_id = p.run_id AND a.robot_id = i
                JOIN latest b ON b.run_id = p.run_id AND b.robot_id = j WHERE i < j),
      newest AS (SELECT run_id, arg_max(mean_sim, cycle) AS m FROM cycles GROUP BY run_id)
    SELECT run_id, 'robots' AS ns, id, round(x, 6) AS x, round(y, 6) AS y, 0.05::DOUBLE AS z, 0.3::DOUBLE AS scale, round(1 - g, 6) AS r, round(g, 6) AS g,
           0.0::DOUBLE AS b, 0.85::DOUBLE AS alpha, NULL AS text, NULL::DOUBLE AS x2, NULL::DOUBLE AS y2 FROM placed_robots
    UNION ALL SELECT run_id, 'labels', id + 1, round(x, 6), round(y, 6), 0.3, 0.25, 1, 1, 1, 1, 'R' || robot_id || chr(10) || printf('%.2f', m), NULL, NULL FROM placed_robots
    UNION ALL SELECT run_id, 'comm_links', id, round(x, 6), round(y, 6), 0.05, 0.02, 0.5, 0.5, 1, 0.6, NULL, round(x2, 6), round(y2, 6) FROM links
    UNION ALL SELECT s.run_id, 'hud', n + coalesce((SELECT count(*) FROM links l WHERE l.run_id = s.run_id), 0), 0, 11, 0.5, 0.5, 1, 1, 0, 1,
           'Mean z* sim: ' || printf('%.4f', m), NULL, NULL FROM sizes s JOIN newest USING (run_id)""")

oracle("world_positions", "world", "SELECT run_id, robot_id, event_id, round(x, 6) AS x, round(y, 6) AS y FROM world")
oracle("yaw", "telemetry", f"SELECT event_id, round({YAW}, 6) AS yaw FROM telemetry")
oracle("peer_distance", "latest", """SELECT a.run_id, a.robot_id, round(coalesce(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), 999.0), 6) AS dist
    FROM latest a LEFT JOIN latest b ON b.run_id = a.run_id AND b.robot_id = a.robot_id + 1""")
oracle("heading_error", "world", f"""SELECT event_id, round(abs(atan2(sin(atan2(0.0 - y, 0.0 - x) - {YAW}), cos(atan2(0.0 - y, 0.0 - x) - {YAW}))), 6) AS heading_error FROM world""")
oracle("wall_proximity", "world", "SELECT event_id, abs(x) > 9.5 OR abs(y) > 9.5 AS near_wall FROM world")
oracle("retention_bands", "telemetry", f"""SELECT event_id, round({SIM}, 6) AS sim,
    CASE WHEN {SIM} > 0.7 THEN 0.20 WHEN {SIM} > 0.4 THEN 0.40 ELSE 0.65 END::DOUBLE AS retention FROM telemetry""")
oracle("trends", "risen", f"SELECT run_id, cycle, {TREND} AS trend FROM risen")
oracle("similarity_colours", "telemetry", f"""SELECT event_id, round(1 - greatest(0, least(1, ({SIM} + 1) / 2)), 6) AS r,
    round(greatest(0, least(1, ({SIM} + 1) / 2)), 6) AS g, 0.0::DOUBLE AS b FROM telemetry""")
oracle("cycle_reports", "judged pair_lists", f"""SELECT run_id, cycle, {TREND} AS trend,
    '[Monitor  t=' || printf('%03d', elapsed_sec) || 's]  Mean pairwise sim: ' || printf('%.4f', mean_sim) || chr(10)
    || '  Δ from last:  ' || printf('%+.4f', delta) || '   Trend: ' || {TREND} || chr(10)
    || '  Active pairs: ' || coalesce(report_text, 'none') || chr(10)
    || '  Baseline: ' || printf('%.4f', baseline) || '   Rise: ' || printf('%+.4f', rise) || ' (min 0.03)   Stable: ' || stable || '/3' || chr(10)
    || '  Status: ' || CASE WHEN converged THEN 'CONVERGED ✓ (monitoring continues)' ELSE 'NOT YET' END AS report
    FROM judged LEFT JOIN pair_lists USING (run_id, cycle)""")
oracle("final_reports", "judged cycle_merges", """
    , done AS (SELECT * FROM judged WHERE newly_converged),
      counts AS (SELECT m.run_id, sender_id, receiver_id, sum(n) AS n FROM cycle_merges m JOIN done d ON m.run_id = d.run_id AND m.cycle <= d.cycle GROUP BY ALL)
    SELECT run_id, 0 AS line, 'CONVERGENCE REACHED at t=' || elapsed_sec || 's' AS text, -1 AS a, -1 AS b FROM done
    UNION ALL SELECT run_id, 1, '  Final mean pairwise similarity: ' || printf('%.4f', mean_sim), -1, -1 FROM done
    UNION ALL SELECT run_id, 2, '  Rise over baseline: ' || printf('%+.4f', rise), -1, -1 FROM done
    UNION ALL SELECT run_id, 3, '  Merge events:', -1, -1 FROM done
    UNION ALL SELECT run_id, 4, '    Robot ' || sender_id || ' → Robot ' || receiver_id || ': ' || n || ' merges', sender_id, receiver_id FROM counts
    UNION ALL SELECT run_id, 5, '  Total merge events: ' || sum(n), -1, -1 FROM counts GROUP BY run_id""")
oracle("vector_algebra", "agents", """SELECT v.agent_id, round(list_dot_product(v.z, a.z), 6) AS dot, round(sqrt(list_dot_product(v.z, v.z)), 6) AS norm,
    round(list_cosine_similarity(v.z, a.z), 6) AS cosine, round(v.z[1] / sqrt(list_dot_product(v.z, v.z)), 6) AS unit_1
    FROM vectors v JOIN agents a ON v.label = a.agent_id""")
oracle("cell_centres", "grids", """SELECT map_id, CAST(cell AS BIGINT) AS cell, round(-map_id + (x + 0.5::DOUBLE) * 0.05::DOUBLE, 6) AS wx,
    round(map_id + (y + 0.5::DOUBLE) * 0.05::DOUBLE, 6) AS wy FROM grids""")
oracle("projected_points", "world", """SELECT event_id, CASE WHEN d >= 0.01 THEN round(x - x / d * 0.7::DOUBLE, 6) END AS px,
    CASE WHEN d >= 0.01 THEN round(y - y / d * 0.7::DOUBLE, 6) END AS py FROM (SELECT event_id, x, y, sqrt(x * x + y * y) AS d FROM world)""")
oracle("pair_texts", "cycles pair_lists", """SELECT run_id, cycle, coalesce(csv_text, '') AS csv_text, coalesce(report_text, 'none') AS report_text
    FROM cycles LEFT JOIN pair_lists USING (run_id, cycle)""")
oracle("cell_classes", "grids", """SELECT map_id, CASE WHEN v = -1 THEN 'unknown' WHEN v < 50 THEN 'free' ELSE 'occupied' END AS class, count(*) AS n FROM grids GROUP BY ALL""")
oracle("elapsed_seconds", "telemetry", """SELECT event_id, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY run_id)) // 1000000 AS elapsed_sec FROM telemetry""")

oracle("share_positions", "placed", """SELECT msg_id, robot_id, round(x, 6) AS x, round(y, 6) AS y, epoch_us(seen) AS seen_us FROM placed WHERE robot_id = sender_id""")
oracle("pairs_in_range", "latest_pairs", "SELECT run_id, i, j, round(dist, 6) AS dist FROM latest_pairs WHERE i < j")
oracle("share_fanout", "receivers", "SELECT run_id, msg_id, sender_id, receiver_id, round(dist, 6) AS dist FROM receivers")
REQUESTS = """, requests AS (SELECT run_id AS request_id, 9 - agent_id % 10 AS ord, agent_id FROM vectors
    UNION ALL SELECT DISTINCT run_id, 10, run_id * 10 + 10 FROM vectors),
    bad AS (SELECT request_id, min(agent_id) AS id FROM requests WHERE agent_id NOT IN (SELECT agent_id FROM vectors) GROUP BY 1)"""
oracle("similarity_matrix", "vectors", REQUESTS + """ SELECT a.request_id, a.ord AS i, b.ord AS j, round(list_cosine_similarity(va.z, vb.z), 6) AS sim
    FROM requests a JOIN requests b USING (request_id) JOIN vectors va ON va.agent_id = a.agent_id JOIN vectors vb ON vb.agent_id = b.agent_id
    WHERE a.request_id NOT IN (SELECT request_id FROM bad)""")
oracle("similarity_request_failures", "vectors", REQUESTS + " SELECT request_id, false AS ok, 'similarity_query failed: ' || id AS error FROM bad")
oracle("merge_request_failures", "vectors agents", """, asked AS (
        SELECT agent_id AS seq, label + CASE WHEN agent_id % 11 = 0 THEN 100 ELSE 0 END AS receiver_id,
               CASE WHEN agent_id % 13 = 0 THEN NULL WHEN agent_id % 7 = 0 THEN 10 ELSE 64 END AS got, agent_id % 17 = 0 AS odd FROM vectors),
    verdicts AS (
        SELECT seq, receiver_id, CASE WHEN receiver_id NOT IN (SELECT agent_id FROM agents) THEN 'unknown agent ' || receiver_id
            WHEN got IS NULL THEN 'no vector' WHEN got <> 64 THEN 'expected 64 values, got ' || got WHEN odd THEN 'not a number' END AS error FROM asked)
    SELECT seq, receiver_id, false AS ok, error FROM verdicts WHERE error IS NOT NULL""")
oracle("usable_targets", "usable", "SELECT map_id, CAST(cluster_id AS BIGINT) AS cluster_id, n_cells, round(tx, 6) AS tx, round(ty, 6) AS ty FROM usable")
for twin in ("frontier_cells", "frontier_cells_joined"):
    oracle(twin, "frontier", "SELECT map_id, CAST(cell AS BIGINT) AS cell, x, y FROM frontier")
oracle("every_robot", "fleet world", """, six AS (SELECT run_id, robot_id, CAST(run_id AS TIMESTAMP) + INTERVAL 6 HOUR AS ts FROM fleet)
    SELECT s.run_id, s.robot_id, round(w.x, 6) AS x, round(w.y, 6) AS y FROM six s
    ASOF LEFT JOIN world w ON s.run_id = w.run_id AND s.robot_id = w.robot_id AND s.ts >= w.ts""")
oracle("induced_edges", "touches", """, busy AS (SELECT graph_id, node_id FROM touches GROUP BY ALL HAVING count(*) >= 3)
    SELECT graph_id, src, dst, etype FROM edges e WHERE EXISTS (FROM busy b WHERE b.graph_id = e.graph_id AND b.node_id = e.src)
    AND EXISTS (FROM busy b WHERE b.graph_id = e.graph_id AND b.node_id = e.dst)""")
PEER_SIMS = """, sims AS (SELECT p.run_id, i, j, list_cosine_similarity(a.z, b.z) AS sim FROM latest_pairs p
    JOIN beliefs a ON a.run_id = p.run_id AND a.robot_id = i JOIN beliefs b ON b.run_id = p.run_id AND b.robot_id = j)"""
oracle("peer_similarities", "latest_pairs beliefs", PEER_SIMS + " SELECT run_id, i, j, round(sim, 6) AS sim FROM sims")

oracle("merge_counts", "receivers", "SELECT run_id, sender_id, receiver_id, count(*) AS n_merges FROM receivers GROUP BY ALL")
oracle("mean_similarity", "vectors", f"""SELECT a.run_id, count(DISTINCT a.agent_id) AS n_agents, round({MEAN_PAIRS}, 6) AS mean_sim
    FROM vectors a JOIN vectors b USING (run_id) GROUP BY a.run_id""")
oracle("mean_similarity_by_label", "vectors", f"""SELECT a.label, count(DISTINCT a.agent_id) AS n_agents, round({MEAN_PAIRS}, 6) AS mean_sim
    FROM vectors a JOIN vectors b USING (label) GROUP BY a.label""")
oracle("row_mean_similarity", "vectors", f"""SELECT a.run_id, a.agent_id, round({MEAN_PAIRS}, 6) AS row_mean FROM vectors a JOIN vectors b USING (run_id) GROUP BY ALL""")
oracle("peer_centroids", "latest_pairs", """SELECT p.run_id, i AS robot_id, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy, count(*) AS n_peers
    FROM latest_pairs p JOIN latest l ON l.run_id = p.run_id AND l.robot_id = p.j GROUP BY ALL""")
oracle("share_retention", "latest_pairs beliefs", PEER_SIMS + """ SELECT run_id, i, round(min(sim), 6) AS min_sim,
    CASE WHEN min(sim) > 0.7 THEN 0.20 WHEN min(sim) > 0.4 THEN 0.40 ELSE 0.65 END::DOUBLE AS retention FROM sims GROUP BY ALL""")
oracle("merge_report", "receivers", """SELECT run_id, sender_id, receiver_id, count(*) AS n_merges, grouping(sender_id) = 1 AS is_total
    FROM receivers GROUP BY GROUPING SETS ((run_id, sender_id, receiver_id), (run_id))""")
oracle("graph_statistics", "nodes touches", """SELECT graph_id, count(*) AS n_nodes, (SELECT count(*) FROM edges e WHERE e.graph_id = n.graph_id) AS n_edges,
    (SELECT count(DISTINCT etype) FROM edges e WHERE e.graph_id = n.graph_id) AS n_relations,
    count(*) FILTER (WHERE node_id NOT IN (SELECT t.node_id FROM touches t WHERE t.graph_id = n.graph_id)) AS n_isolated FROM nodes n GROUP BY graph_id""")
oracle("cluster_centroids", "targets", "SELECT map_id, CAST(cluster_id AS BIGINT) AS cluster_id, n_cells, round(tx, 6) AS tx, round(ty, 6) AS ty FROM targets")
oracle("trajectory_metrics", "cycles runs", """, top AS (SELECT run_id, max(mean_sim) AS peak, arg_max(mean_sim, cycle) AS final_sim FROM cycles GROUP BY run_id),
    peaked AS (SELECT t.*, (SELECT min(elapsed_sec) FROM cycles c WHERE c.run_id = t.run_id AND c.mean_sim = t.peak) AS time_to_peak FROM top t),
    sloped AS (SELECT p.*, (SELECT CASE WHEN count(*) > 1 THEN regr_slope(mean_sim, CAST(elapsed_sec AS DOUBLE)) END FROM cycles c WHERE c.run_id = p.run_id AND c.elapsed_sec > p.time_to_peak) AS slope FROM peaked p)
    SELECT n_robots, CAST(seed AS INTEGER) AS seed, count(*) AS n_runs, round(avg(peak), 6) AS peak, round(avg(time_to_peak), 6) AS time_to_peak,
           round(avg(slope) * 1000, 6) AS post_peak_slope, round(avg(final_sim), 6) AS final_sim
    FROM sloped JOIN runs USING (run_id) GROUP BY ROLLUP (n_robots, seed)""")
oracle("duplicate_writers", "telemetry", """SELECT run_id, robot_id, CAST(hour(ts) AS INTEGER) AS hour, count(DISTINCT event_type) AS n_writers,
    count(DISTINCT event_type) > 1 AS suspect FROM telemetry GROUP BY ALL""")
oracle("merged_embeddings", "folds", """SELECT agent_id, n_folded, CAST(unnest(range(64)) AS INTEGER) AS pos, round(unnest(z), 6) AS z FROM folds""")
oracle("merge_replies", "folds", """SELECT agent_id, 0.5::DOUBLE AS gate, round(sqrt(list_dot_product(z, z)), 6) AS z_norm, round(z[1], 6) AS z_first FROM folds""")
oracle("share_traffic", "receivers", """SELECT s.run_id, s.sender_id AS robot_id, epoch_us(time_bucket(INTERVAL 6 HOUR, s.ts)) AS bucket_us, count(*) AS broadcasts,
    CAST(sum((SELECT count(*) FROM receivers r WHERE r.msg_id = s.msg_id)) AS BIGINT) AS recipients, CAST(sum(strlen(payload)) AS BIGINT) AS bytes,
    round(avg(CASE WHEN (k + 0.5::DOUBLE) / 50 - 1 > 0.7 THEN 0.2::DOUBLE WHEN (k + 0.5::DOUBLE) / 50 - 1 > 0.4 THEN 0.4 ELSE 0.65 END), 6) AS mean_retention FROM shares s GROUP BY ALL""")
oracle("peers_in_range", "latest_pairs", """SELECT l.run_id, l.robot_id, count(j) AS n_peers, CAST(0 AS BIGINT) AS page, coalesce(string_agg(j, ',' ORDER BY j), '') AS peers
    FROM latest l LEFT JOIN latest_pairs p ON p.run_id = l.run_id AND p.i = l.robot_id GROUP BY l.run_id, l.robot_id""")
oracle("exploration_progress", "usable", """SELECT m.map_id, count(u.cluster_id) AS n_left, count(u.cluster_id) = 0 AS complete
    FROM (SELECT DISTINCT map_id FROM grids) m LEFT JOIN usable u ON u.map_id = m.map_id GROUP BY m.map_id""")

oracle("cycle_rise", "risen", """SELECT run_id, cycle, round(mean_sim, 6) AS mean_sim, round(baseline, 6) AS baseline, has_prev, round(delta, 6) AS delta, round(rise, 6) AS rise FROM risen""")
oracle("cycle_stability", "steady", "SELECT run_id, cycle, stable FROM steady")
oracle("cycle_convergence", "judged", "SELECT run_id, cycle, merges, stable, newly_converged, converged FROM judged")
oracle("run_summary", "judged", """SELECT run_id, count(*) AS n_cycles, round(max(baseline), 6) AS baseline, round(max(mean_sim), 6) AS peak,
    round(arg_max(mean_sim, cycle), 6) AS final_sim, min(cycle) FILTER (WHERE newly_converged) AS converged_cycle FROM judged GROUP BY run_id""")
oracle("stuck_ticks", "stuck_rows", ", " + stuck_sql("stuck_rows", True) + " SELECT run_id, robot_id, event_id, stuck FROM verdict")
oracle("stuck_triggers", "stuck_rows", ", " + stuck_sql("stuck_rows", False) + """ SELECT run_id, robot_id, event_id FROM (SELECT *,
    lag(stuck, 1, false) OVER (PARTITION BY run_id, robot_id ORDER BY tick, event_id) AS was FROM verdict) WHERE stuck AND NOT was""")
ESCALATED = """CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) <= 21600000000 AND
    sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) <= 5.0 THEN 2.0 ELSE 1.0 END::DOUBLE AS factor"""
oracle("escape_escalations", "world", f"""SELECT robot_id, event_id, factor = 2 AS escalated, round(0.9::DOUBLE * factor, 6) AS reverse_m,
    4.0::DOUBLE * factor AS suppress_sec, round(3.0::DOUBLE * (0.9::DOUBLE * factor / 0.15::DOUBLE), 6) AS reverse_cap_sec
    FROM (SELECT *, {ESCALATED} FROM world WHERE event_type = 'error' WINDOW w AS (PARTITION BY robot_id ORDER BY ts, event_id))""")
oracle("suppressed_ticks", "world", f""", escapes AS (SELECT run_id, robot_id, ts, epoch_us(ts) + CAST(factor * 3600000000 AS BIGINT) AS until
    FROM (SELECT *, {ESCALATED} FROM world WHERE event_type = 'error' WINDOW w AS (PARTITION BY run_id, robot_id ORDER BY ts, event_id)))
    SELECT t.run_id, t.robot_id, t.event_id, coalesce(epoch_us(t.ts) < e.until, false) AS suppressed
    FROM (SELECT * FROM world WHERE event_type IN ('click', 'view')) t
    ASOF LEFT JOIN escapes e ON t.run_id = e.run_id AND t.robot_id = e.robot_id AND t.ts >= e.ts""")
oracle("behaviour_timeline", "world fleet", """, ticks AS (SELECT run_id, robot_id, ts, event_id, x, y,
        lag(ts) OVER (PARTITION BY run_id, robot_id ORDER BY ts, event_id) AS before FROM world WHERE event_type IN ('click', 'view')),
    control AS (SELECT run_id, robot_id, ts AS cts, event_type FROM world WHERE event_type IN ('purchase', 'signup')),
    seen AS (SELECT t.*, c.cts, coalesce(c.event_type = 'purchase', false) AS shared FROM ticks t
             ASOF LEFT JOIN control c ON t.run_id = c.run_id AND t.robot_id = c.robot_id AND t.ts >= c.cts),
    peers AS (SELECT t.event_id, t.x, t.y, t.ts, t.run_id, f.robot_id FROM ticks t JOIN fleet f ON f.run_id = t.run_id AND f.robot_id <> t.robot_id),
    near_ticks AS (SELECT DISTINCT p.event_id FROM peers p ASOF JOIN world w ON p.run_id = w.run_id AND p.robot_id = w.robot_id AND p.ts >= w.ts
                   WHERE sqrt((p.x - w.x) ** 2 + (p.y - w.y) ** 2) < 3.0)
    SELECT run_id, robot_id, event_id, CASE WHEN shared AND ts <= cts + INTERVAL 2 HOUR THEN 'disperse'
        WHEN shared AND (before IS NULL OR before <= cts + INTERVAL 2 HOUR) THEN 'explore'
        WHEN event_id IN (SELECT event_id FROM near_ticks) THEN 'flock' ELSE 'explore' END AS state FROM seen""")
oracle("frozen_pairs", "cycle_pairs", """SELECT run_id, cycle, i, j, round(dist, 6) AS dist, round(max(dist) OVER w - min(dist) OVER w, 6) AS spread,
    count(*) OVER w = 4 AND max(dist) OVER w - min(dist) OVER w < 0.01 AS frozen
    FROM cycle_pairs WINDOW w AS (PARTITION BY run_id, i, j ORDER BY cycle RANGE BETWEEN 3 PRECEDING AND CURRENT ROW)""")
oracle("isolated_robots", "cycle_pairs", """SELECT run_id, cycle, robot_id FROM cycle_positions c
    WHERE NOT EXISTS (FROM cycle_pairs p WHERE p.run_id = c.run_id AND p.cycle = c.cycle AND (p.i = c.robot_id OR p.j = c.robot_id))""")
oracle("goal_outcomes", "outcomes", "SELECT robot_id, goal_num, outcome, outcome <> 'reached' AS blacklisted FROM outcomes")
oracle("goal_blacklist", "outcomes", "SELECT DISTINCT robot_id, round(gx, 6) AS bx, round(gy, 6) AS by FROM outcomes WHERE outcome <> 'reached'")
oracle("dispatch_gaps", "outcomes", """SELECT robot_id, goal_num, round(gap, 6) AS gap_sec, coalesce(gap < 600, false) AS too_soon FROM (SELECT *,
    (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY robot_id ORDER BY ts, goal_num))) / 1000000.0::DOUBLE AS gap FROM outcomes WHERE outcome <> 'resent')""")
oracle("stale_maps", "outcomes", """, maps AS (SELECT CAST(l_suppkey % 10 AS INTEGER) AS robot_id, l_shipdate + INTERVAL 1 SECOND * l_orderkey AS ts FROM lineitem)
    SELECT g.robot_id, g.goal_num, epoch_us(m.ts) AS next_us, coalesce(epoch_us(m.ts) - (epoch_us(g.ts) + CAST(took AS BIGINT) * 1000000) > 43200000000, true) AS stale
    FROM (FROM outcomes WHERE outcome NOT IN ('resent', 'timed_out')) g ASOF LEFT JOIN maps m ON g.robot_id = m.robot_id AND g.ts < m.ts""")
oracle("carried_similarity", "cycle_pairs beliefs", """, directed AS (SELECT run_id, cycle, i, j FROM cycle_pairs UNION ALL SELECT run_id, cycle, j, i FROM cycle_pairs),
    read AS (SELECT d.*, CASE WHEN (cycle + i + j) % 3 <> 0 THEN list_cosine_similarity(a.z, b.z) + cycle / 100.0::DOUBLE END AS sim FROM directed d
             JOIN beliefs a ON a.run_id = d.run_id AND a.robot_id = i JOIN beliefs b ON b.run_id = d.run_id AND b.robot_id = j)
    SELECT run_id, i, j, cycle, round(last_value(sim IGNORE NULLS) OVER (PARTITION BY run_id, i, j ORDER BY cycle), 6) AS known_sim FROM read""")
oracle("running_merges", "cycles cycle_merges", """SELECT c.run_id, c.cycle, CAST(coalesce((SELECT sum(n) FROM cycle_merges m WHERE m.run_id = c.run_id AND m.cycle <= c.cycle), 0) AS BIGINT) AS merges FROM cycles c""")
oracle("next_targets", "usable", """, seen AS (SELECT *, sqrt((tx + map_id) ** 2 + (ty - map_id) ** 2) AS d FROM usable),
    best AS (SELECT * FROM seen QUALIFY row_number() OVER (PARTITION BY map_id ORDER BY d < 0.5, d, cluster_id) = 1)
    SELECT map_id, map_id AS robot_id, CAST(cluster_id AS BIGINT) AS cluster_id, n_cells, d < 0.5 AS projected, round(tx, 6) AS fx, round(ty, 6) AS fy,
           round(CASE WHEN d < 0.5 THEN -map_id + (tx + map_id) / d * 0.7::DOUBLE ELSE tx END, 6) AS gx,
           round(CASE WHEN d < 0.5 THEN map_id + (ty - map_id) / d * 0.7::DOUBLE ELSE ty END, 6) AS gy FROM best WHERE d >= 0.01""")
oracle("explored_targets", "targets outcomes", """, bans AS (
        SELECT robot_id, gx AS px, gy AS py, min(CASE WHEN outcome = 'resent' THEN ts ELSE ts + INTERVAL 1 SECOND * CAST(took AS BIGINT) END) AS banned
        FROM outcomes WHERE outcome <> 'reached' GROUP BY ALL),
    choices AS (
        SELECT map_id, cluster_id, n_cells, robot_id, tx + map_id AS tx, ty - map_id AS ty, first + INTERVAL 1 DAY * (robot_id + 1) AS chosen
        FROM targets, (SELECT min(ts) AS first FROM outcomes), (VALUES (0), (5)) s(shift), LATERAL (SELECT CAST((map_id + shift) % 10 AS INTEGER) AS robot_id)),
    seen AS (
        SELECT *, sqrt((tx - 0.2::DOUBLE) ** 2 + (ty - 0.1::DOUBLE) ** 2) AS d FROM choices c
        WHERE NOT EXISTS (SELECT 1 FROM bans b WHERE b.robot_id = c.robot_id AND banned < chosen AND sqrt((tx - px) ** 2 + (ty - py) ** 2) < 0.4)),
    best AS (SELECT * FROM seen QUALIFY row_number() OVER (PARTITION BY map_id, robot_id ORDER BY d < 0.5, d, cluster_id) = 1)
    SELECT map_id, robot_id, CAST(cluster_id AS BIGINT) AS cluster_id, n_cells, d < 0.5 AS projected, round(tx, 6) AS fx, round(ty, 6) AS fy,
           round(CASE WHEN d < 0.5 THEN 0.2 + (tx - 0.2::DOUBLE) / d * 0.7::DOUBLE ELSE tx END, 6) AS gx,
           round(CASE WHEN d < 0.5 THEN 0.1 + (ty - 0.1::DOUBLE) / d * 0.7::DOUBLE ELSE ty END, 6) AS gy FROM best WHERE d >= 0.01""")
oracle("interleaved_clock", "shares", """SELECT run_id, epoch_us(ts) AS us, event_id, 0 AS kind, robot_id, NULL::INTEGER AS sender_id FROM telemetry
    UNION ALL SELECT run_id, epoch_us(ts), msg_id, 1, NULL, sender_id FROM shares""")

oracle("graph_nodes", "shares", """SELECT msg_id AS graph_id, CAST(0 AS BIGINT) AS node_id, k + 0.5::DOUBLE AS x0, 1.0::DOUBLE AS x1 FROM shares
    UNION ALL SELECT msg_id, 1, 0.25, robot_id FROM shares""")
oracle("graph_edges", "shares", """SELECT msg_id AS graph_id, CAST(0 AS BIGINT) AS edge_pos, CAST(0 AS BIGINT) AS src, CAST(1 AS BIGINT) AS dst, k AS etype FROM shares
    UNION ALL SELECT msg_id, 1, 1, 0, 3 FROM shares""")
oracle("packed_graphs", "shares", """SELECT msg_id AS graph_id, CAST(0 AS BIGINT) AS part, CAST(0 AS BIGINT) AS node_offset, '{"x":[[' || k || '.5,1.0],[0.25,' || robot_id
    || '.0]],"edge_index":[[0,1],[1,0]],"edge_type":[' || k || ',3],"num_nodes":2,"agent_id":-1}' AS graph_json FROM shares""")
oracle("compressed_nodes", "scores", """SELECT graph_id, node_id, degree, score, rank, rank <= ceil(0.4::DOUBLE * n) AS kept
    FROM (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY score DESC, node_id) AS rank FROM scores)""")
oracle("compression_stats", "kept", """SELECT graph_id, n_nodes, n_top + n_bridges AS n_kept,
    (SELECT count(*) FROM edges e WHERE e.graph_id = s.graph_id AND (e.graph_id, e.src) IN (FROM kept) AND (e.graph_id, e.dst) IN (FROM kept)) AS n_edges_kept,
    n_bridges AS bridge_nodes_kept, round((n_top + n_bridges) / n_nodes, 6) AS node_retention
    FROM (SELECT graph_id, count(*) AS n_nodes, count(*) FILTER (WHERE top) AS n_top,
                 (SELECT count(*) FROM bridges b WHERE b.graph_id = m.graph_id) AS n_bridges FROM marked m GROUP BY graph_id) s""")
oracle("frontier_clusters", "clusters", "SELECT map_id, CAST(cell AS BIGINT) AS cell, CAST(cluster_id AS BIGINT) AS cluster_id FROM clusters")
oracle("contact_components", "contact_reach", """SELECT run_id, cycle, robot_id, component, count(*) OVER (PARTITION BY run_id, cycle, component) AS n_members,
    count(*) OVER (PARTITION BY run_id, cycle, component) = 1 AS isolated FROM (SELECT run_id, cycle, robot_id, min(root) AS component FROM contact_reach GROUP BY ALL)""")
oracle("union_connectivity", "union_reach", """SELECT run_id, "at", count(DISTINCT component) AS n_components, count(DISTINCT component) = 1 AS connected
    FROM (SELECT run_id, "at", robot_id, min(root) AS component FROM union_reach GROUP BY ALL) GROUP BY ALL""")
oracle("first_contacts", "hour_reach", """, labelled AS (SELECT run_id, "at", robot_id, min(root) AS component FROM hour_reach GROUP BY ALL),
    parts AS (SELECT run_id, "at", count(DISTINCT component) AS n, count(DISTINCT robot_id) AS n_robots FROM labelled GROUP BY ALL)
    SELECT run_id, "at" AS t, n_joined FROM (
        SELECT run_id, "at", coalesce(lag(n) OVER (PARTITION BY run_id ORDER BY "at"), n_robots) - n AS n_joined FROM parts) WHERE n_joined > 0""")
oracle("cluster_similarity", "end_parts beliefs", """, known AS (SELECT run_id, robot_id, component, z FROM end_parts JOIN beliefs USING (run_id, robot_id)),
    sims AS (SELECT a.run_id, a.component = b.component AS inner_pair, list_cosine_similarity(a.z, b.z) AS sim FROM known a JOIN known b ON a.run_id = b.run_id AND a.robot_id <> b.robot_id)
    SELECT k.run_id, count(DISTINCT component) AS n_components,
           round(coalesce((SELECT avg(sim) FROM sims s WHERE s.run_id = k.run_id AND inner_pair), 0), 6) AS within_sim,
           round(coalesce((SELECT avg(sim) FROM sims s WHERE s.run_id = k.run_id AND NOT inner_pair), 0), 6) AS between_sim FROM known k GROUP BY k.run_id""")
oracle("graph_embeddings", "nodes", """SELECT graph_id, round(avg(node_id % 7), 6) AS z0, round(avg(node_id % 11), 6) AS z1, round(avg(node_id // 1000000000), 6) AS z2 FROM nodes GROUP BY graph_id""")
oracle("packed_embeddings", "shares", "SELECT msg_id, round((k + 0.75::DOUBLE) / 2, 6) AS z0, round((1.0::DOUBLE + robot_id) / 2, 6) AS z1 FROM shares")
ORDER_GRAPHS = """lines AS (SELECT l_orderkey AS g, l_linenumber - 1 AS node, l_quantity <> 13 AS there, l_suppkey % 3 AS dst,
            CASE WHEN l_partkey % 97 = 0 THEN -1 ELSE l_partkey % 5 END AS etype FROM lineitem),
        faults AS (
            SELECT g, 1 AS k, format('node ids run from {} to {} over {} nodes', min(node), max(node), count(*)) AS text
            FROM lines WHERE there GROUP BY g HAVING min(node) <> 0 OR max(node) <> count(*) - 1
            UNION ALL
            SELECT g, 4, format('{} repeated node ids such as {}', count(*), min(node)) FROM (
                SELECT g, node FROM lines WHERE there GROUP BY g, node HAVING count(*) > 1) GROUP BY g
            UNION ALL
            SELECT g, 6, format('{} repeated edges such as {}-{} of relation {}', n, m.s, m.d, m.e) FROM (
                SELECT g, count(*) AS n, min({'s': node, 'd': dst, 'e': etype}) AS m FROM (
                    SELECT g, node, dst, etype FROM lines GROUP BY ALL HAVING count(*) > 1) GROUP BY g)
            UNION ALL
            SELECT g, 5, format('{} edge ends without a node such as {}', count(*), min(e)) FROM (
                SELECT g, unnest([node, dst]) AS e FROM lines) ends
            WHERE NOT EXISTS (SELECT 1 FROM lines l WHERE l.g = ends.g AND l.node = ends.e AND l.there) GROUP BY g
            UNION ALL
            SELECT g, 7, format('{} edges without a valid relation', count(*)) FROM lines WHERE etype < 0 GROUP BY g)"""
oracle("compress_rejects", "", f"WITH {ORDER_GRAPHS} SELECT g AS graph_id, string_agg(text, '; ' ORDER BY k) AS error FROM faults GROUP BY g")
oracle("compress_accepted", "", f"""WITH {ORDER_GRAPHS} SELECT g AS graph_id, count(*) AS n_nodes, CAST(ceil(count(*) * 0.4::DOUBLE) AS BIGINT) AS top_nodes
    FROM lines WHERE there AND g NOT IN (SELECT g FROM faults) GROUP BY g""")
oracle("graph_sample", "", "SELECT p_partkey AS graph_id FROM part ORDER BY substr(md5(p_partkey || ':7'), 1, 15), p_partkey LIMIT 50")
oracle("message_embeddings", "shares", "SELECT msg_id, round((k + 0.75::DOUBLE) / 2, 6) AS z0, round((1.0::DOUBLE + robot_id) / 2, 6) AS z1 FROM shares")
oracle("monitor_cycles", "monitor", """SELECT run_id, cycle, n_agents, round(mean_sim, 6) AS mean_sim, merges, round(first_value(mean_sim) OVER w, 6) AS baseline,
    round(coalesce(mean_sim - lag(mean_sim) OVER w, 0), 6) AS delta, round(mean_sim - first_value(mean_sim) OVER w, 6) AS rise
    FROM monitor WINDOW w AS (PARTITION BY run_id ORDER BY cycle)""")

oracle("stream_latest_positions", "world", """SELECT run_id, robot_id, event_id, round(x, 6) AS x, round(y, 6) AS y FROM world
    QUALIFY row_number() OVER (PARTITION BY run_id, robot_id ORDER BY ts DESC, event_id DESC) = 1""")
oracle("stream_receivers", "receivers", "SELECT run_id, msg_id, sender_id, receiver_id, round(dist, 6) AS dist FROM receivers")
oracle("stream_merge_counts", "receivers", "SELECT run_id, sender_id, receiver_id, count(*) AS n_merges FROM receivers GROUP BY ALL")
oracle("stream_cycles", "hour_cycles", "SELECT run_id, epoch_us(ts) AS us, round(mean_sim, 6) AS mean_sim, merges FROM hour_cycles")
oracle("stream_convergence", "closed_cycles", """, steps AS (SELECT run_id, ts, mean_sim, CAST(sum(merges) OVER w AS BIGINT) AS merges, first_value(mean_sim) OVER w AS baseline,
        coalesce(mean_sim - lag(mean_sim) OVER w, 0) AS delta, lag(mean_sim) OVER w IS NOT NULL AS has_prev, row_number() OVER w AS pos
        FROM closed_cycles WINDOW w AS (PARTITION BY run_id ORDER BY ts)),
    calm AS (SELECT *, mean_sim - baseline AS rise, pos - max(CASE WHEN NOT (has_prev AND abs(delta) < 0.005) THEN pos END) OVER (PARTITION BY run_id ORDER BY ts) AS stable FROM steps)
    SELECT run_id, epoch_us(ts) AS us, round(mean_sim, 6) AS mean_sim, merges, round(baseline, 6) AS baseline, round(delta, 6) AS delta, round(rise, 6) AS rise, stable,
           bool_or(merges > 0 AND rise >= 0.03 AND stable >= 3) OVER (PARTITION BY run_id ORDER BY ts) AS converged FROM calm""")
oracle("stream_stuck", "stuck_rows", ", " + stuck_sql("stuck_rows", True) + " SELECT run_id, robot_id, event_id, stuck FROM verdict")
ORACLES["stream_merge"] = ORACLES["merged_embeddings"]
oracle("stream_subscription", "", "SELECT event_id, user_id FROM events WHERE ts >= TIMESTAMP '2024-01-16'")
oracle("stream_share_traffic", "telemetry", """SELECT run_id, robot_id, epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start_us, count(*) AS broadcasts,
    CAST(8 * count(*) AS BIGINT) AS bytes FROM telemetry WHERE event_type = 'purchase' GROUP BY ALL
    HAVING time_bucket(INTERVAL 1 HOUR, any_value(ts)) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 1 MINUTE FROM telemetry WHERE event_type = 'purchase')""")
oracle("stream_encounters", "heard", """, contacts AS (SELECT run_id, least(sender_id, receiver_id) AS i, greatest(sender_id, receiver_id) AS j, ts FROM heard),
    cut AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY run_id, i, j ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM contacts),
    numbered AS (SELECT *, sum(new) OVER (PARTITION BY run_id, i, j ORDER BY ts) AS n FROM cut)
    SELECT run_id, i, j, epoch_us(min(ts)) AS start_us, epoch_us(max(ts) + INTERVAL 2 HOUR) AS end_us, count(*) AS n_contacts FROM numbered GROUP BY run_id, i, j, n
    HAVING max(ts) + INTERVAL 2 HOUR <= (SELECT max(ts) - INTERVAL 1 MINUTE FROM contacts)""")
oracle("stream_frontiers", "targets", "SELECT map_id, CAST(cluster_id AS BIGINT) AS cluster_id, n_cells, round(tx, 6) AS tx, round(ty, 6) AS ty FROM targets")
