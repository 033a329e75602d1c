"""The registered queries' results stated in SQL over the same tables."""

_CANDIDATES = """
  candidates AS (SELECT e.election_id, c.id AS candidate_id, c.ord FROM (SELECT DISTINCT election_id FROM ballots) e, (SELECT unnest({ids}) AS id, unnest(range(len({ids}))) AS ord) c)"""


def _with(ballots: str, ids: list[str]) -> str:
    return f"WITH RECURSIVE ballots AS ({ballots}),{_CANDIDATES.format(ids=ids)}"


EVENTS = ["click", "error", "purchase", "signup", "view", "ghost"]
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]

SINGLE = _with(
    """SELECT strftime(date_trunc('week', ts), '%Y-%m-%d') AS election_id, event_id::VARCHAR AS voter_id,
    CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 23 = 0 THEN 'unknown' ELSE event_type END AS choice FROM events""",
    EVENTS,
)
APPROVAL = _with(
    """SELECT c_mktsegment AS election_id, c_custkey::VARCHAR AS voter_id, CASE WHEN c_custkey % 10 = 0 THEN [] ELSE coalesce(o.used, []) END AS approvals
    FROM customer LEFT JOIN (SELECT o_custkey, list(DISTINCT o_orderpriority) AS used FROM orders GROUP BY 1) o ON o_custkey = c_custkey""",
    PRIORITIES,
)
SCORE = _with("SELECT l_linestatus AS election_id, l_orderkey::VARCHAR AS voter_id, l_returnflag AS flag, max(round(l_discount * 100)::INT) AS s FROM lineitem GROUP BY 1, 2, 3", ["A", "N", "R"])


def ranked(by: str) -> str:
    return _with(
        f"""SELECT {by}::VARCHAR AS election_id, c_custkey::VARCHAR AS voter_id, coalesce(r.ranking, []) AS ranking FROM customer LEFT JOIN (
      SELECT o_custkey, list(o_orderpriority ORDER BY n DESC, p DESC, o_orderpriority) AS ranking
      FROM (SELECT o_custkey, o_orderpriority, count(*) AS n, max(o_totalprice) AS p FROM orders GROUP BY 1, 2) GROUP BY 1) r ON o_custkey = c_custkey""",
        PRIORITIES,
    )


QUADRATIC = _with(
    """SELECT (user_id % 4)::VARCHAR AS election_id, user_id::VARCHAR AS voter_id, user_id % 13 = 0 AS abstains, CASE WHEN user_id % 7 = 0 THEN 60 ELSE 100 END AS budget,
    event_type AS id, (1 + n % 5) * CASE WHEN event_type = 'error' THEN -1 ELSE 1 END AS v FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2)""",
    ["click", "error", "purchase", "signup"],
)

#: From (election_id, candidate_id, votes): the highest of each election, the smallest id where several are tied.
_TOP = """top AS (SELECT election_id, max(votes) AS best FROM counts GROUP BY 1),
  won AS (SELECT election_id, min(candidate_id) AS winner, count(*) > 1 AS tiebreak_applied FROM counts JOIN top USING (election_id) WHERE votes = best GROUP BY 1)"""
_COUNTS = "counts AS (SELECT c.election_id, c.candidate_id, coalesce(s.votes, 0)::BIGINT AS votes FROM candidates c LEFT JOIN sums s USING (election_id, candidate_id))"
_PLURALITY = f"{SINGLE}, sums AS (SELECT election_id, choice AS candidate_id, count(*) AS votes FROM ballots WHERE choice IS NOT NULL GROUP BY 1, 2), {_COUNTS}"
_APPROVED = f"""{APPROVAL}, sums AS (SELECT election_id, id AS candidate_id, count(*) AS votes FROM (SELECT election_id, unnest(approvals) AS id FROM ballots) GROUP BY 1, 2), {_COUNTS},
  heads AS (SELECT election_id, count(*)::BIGINT AS total_ballots, count(*) FILTER (len(approvals) = 0)::BIGINT AS abstentions FROM ballots GROUP BY 1)"""
_SCORED = f"""{SCORE}, sums AS (SELECT election_id, flag AS candidate_id, sum(s) AS votes FROM ballots GROUP BY 1, 2), {_COUNTS},
  heads AS (SELECT election_id, count(DISTINCT voter_id)::BIGINT AS total_ballots FROM ballots GROUP BY 1)"""
_BORDA = f"""{ranked("c_nationkey")}, placed AS (SELECT election_id, unnest(ranking) AS candidate_id, unnest(range(len(ranking))) AS pos FROM ballots),
  sums AS (SELECT election_id, candidate_id, sum(4 - pos) AS votes FROM placed GROUP BY 1, 2), {_COUNTS},
  heads AS (SELECT election_id, count(*)::BIGINT AS total_ballots, count(*) FILTER (len(ranking) = 0)::BIGINT AS abstentions FROM ballots GROUP BY 1)"""
_QUADRATIC = f"""{QUADRATIC}, cast_ AS (SELECT * FROM ballots WHERE NOT abstains), sums AS (SELECT election_id, id AS candidate_id, sum(v) AS votes FROM cast_ GROUP BY 1, 2), {_COUNTS}"""
_MATRIX = """
  pairs AS (SELECT a.election_id, a.candidate_id AS a, b.candidate_id AS b FROM candidates a JOIN candidates b ON a.election_id = b.election_id AND a.candidate_id <> b.candidate_id),
  placed AS (SELECT election_id, voter_id, unnest(ranking) AS id, unnest(range(len(ranking))) AS pos FROM ballots),
  prefers AS (SELECT x.election_id, x.id AS a, y.id AS b, count(*) AS votes FROM placed x JOIN placed y ON x.election_id = y.election_id AND x.voter_id = y.voter_id AND x.pos < y.pos GROUP BY 1, 2, 3),
  matrix AS (SELECT p.election_id, p.a, p.b, coalesce(v.votes, 0)::BIGINT AS votes FROM pairs p LEFT JOIN prefers v USING (election_id, a, b)),
  margins AS (SELECT m.election_id, m.a, m.b, m.votes, n.votes AS against, m.votes - n.votes AS margin FROM matrix m JOIN matrix n ON m.election_id = n.election_id AND m.a = n.b AND m.b = n.a),
  wins AS (SELECT election_id, a AS candidate_id, count(*) FILTER (margin > 0)::BIGINT AS votes, count(*) AS others FROM margins GROUP BY 1, 2),
  best AS (SELECT election_id, candidate_id FROM wins WHERE votes = others),
  edges AS (SELECT election_id, row_number() OVER (PARTITION BY election_id ORDER BY margin DESC, votes DESC, a, b)::INT AS seq, a AS winner, b AS loser, margin, votes AS winning_votes FROM margins WHERE margin > 0)"""
_PAIRWISE = f"{ranked('c_nationkey')}, {_MATRIX}"
_LOCK = f"""{_PAIRWISE},
  fold AS (
    SELECT election_id, 0 AS seq, [{{'w': '', 'l': ''}}] AS reach, false AS skipped, '' AS winner, '' AS loser, 0::BIGINT AS margin FROM (SELECT DISTINCT election_id FROM candidates) WHERE election_id NOT IN (SELECT election_id FROM best)
    UNION ALL
    SELECT election_id, seq, CASE WHEN cycle THEN reach ELSE list_distinct(list_concat(reach, flatten(list_transform(
        list_append(list_transform(list_filter(reach, lambda p: p.l = winner), lambda p: p.w), winner),
        lambda x: list_transform(list_append(list_transform(list_filter(reach, lambda p: p.w = loser), lambda p: p.l), loser), lambda y: {{'w': x, 'l': y}}))))) END, cycle, winner, loser, margin
    FROM (SELECT f.election_id, e.seq, f.reach, e.winner, e.loser, e.margin, list_contains(f.reach, {{'w': e.loser, 'l': e.winner}}) AS cycle FROM fold f JOIN edges e ON e.election_id = f.election_id AND e.seq = f.seq + 1)),
  beaten AS (SELECT DISTINCT election_id, loser FROM fold WHERE seq > 0 AND NOT skipped)"""
_IRV = f"""{ranked("c_mktsegment")},
  cast_ AS (SELECT election_id, ranking FROM ballots WHERE len(ranking) > 0),
  totals AS (SELECT election_id, count(*) AS n_cast FROM cast_ GROUP BY 1),
  runs AS (
    SELECT election_id, 0 AS round_number, list(candidate_id ORDER BY ord) AS l, []::BIGINT[] AS n, 0::BIGINT AS active, false AS done, NULL::VARCHAR AS winner, []::VARCHAR[] AS gone, false AS tied, false AS was_tied
    FROM candidates GROUP BY 1
    UNION ALL
    SELECT election_id, round_number, l, n, active, done,
      CASE WHEN last THEN l[1] WHEN done THEN l[list_position(n, list_max(n))] WHEN len(lowest) = len(l) THEN list_min(l) END,
      CASE WHEN done THEN [] WHEN len(lowest) = len(l) THEN list_filter(l, lambda c: c <> list_min(l)) ELSE lowest END,
      NOT done AND len(lowest) = len(l), tied
    FROM (SELECT *, last OR list_max(n) * 2 > active AS done, list_filter(l, lambda c, i: n[i] = list_min(n)) AS lowest
      FROM (SELECT election_id, round_number, l, last, tied, list_transform(l, lambda c: len(list_filter(ch, lambda x: x = c))::BIGINT) AS n, len(list_filter(ch, lambda x: x IS NOT NULL))::BIGINT AS active
        FROM (SELECT r.election_id, r.round_number + 1 AS round_number, list_filter(r.l, lambda c: NOT list_contains(r.gone, c)) AS l, r.round_number > 0 AND len(r.l) - len(r.gone) = 1 AS last, r.tied OR r.was_tied AS tied,
            list(list_filter(b.ranking, lambda c: list_contains(list_filter(r.l, lambda d: NOT list_contains(r.gone, d)), c))[1]) AS ch
          FROM runs r JOIN cast_ b ON b.election_id = r.election_id WHERE NOT r.done GROUP BY r.election_id, r.round_number, r.l, r.gone, r.tied, r.was_tied)))),
  rounds AS (SELECT r.*, t.n_cast FROM runs r JOIN totals t USING (election_id) WHERE round_number > 0)"""

_SET_UPS = """WITH names AS (SELECT n_regionkey, list(n_name ORDER BY n_name) AS names FROM nation GROUP BY 1),
  k AS (SELECT * FROM (VALUES (0, 'single_choice'), (1, 'approval'), (2, 'ranked_choice'), (3, 'score'), (4, 'quadratic'), (5, 'plurality')) v(k, ballot_type)),
  set_ups AS (SELECT r_name, ballot_type, CASE WHEN (r_regionkey + k) % 5 = 0 THEN '  ' ELSE '  Election of ' || r_name || chr(9) || ' ' END AS title, r_regionkey * 3 AS min_score, (r_regionkey - 1) * 50 AS credit_budget, r_regionkey <> 4 AS allow,
    CASE WHEN r_regionkey = 2 THEN list_append(list_slice(names, 1, (r_regionkey + k) % 5), names[1]) ELSE list_slice(names, 1, (r_regionkey + k) % 5) END AS candidates
    FROM region JOIN names ON n_regionkey = r_regionkey, k)"""
_UUID = "'00000000-0000-4000-8000-' || lpad({}::VARCHAR, 12, '0')"
_NUMBERED = "WITH l AS (SELECT *, l_quantity::INT AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity) - 1 AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders))"
_LOADED = """WITH p AS (SELECT o_orderkey AS id, c_custkey AS author_id, c_name AS handle FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND o_orderkey % 9 <> 0),
  l AS (SELECT l_orderkey AS id, l_linenumber % 5 AS d, CASE WHEN l_linenumber % 3 <> 0 THEN l_suppkey % 25 END AS g, l_linenumber = 1 AS own FROM lineitem),
  t AS (SELECT l.id, string_agg(r_name || ':' || coalesce(n_name, '-') || ':' || own::VARCHAR, ',' ORDER BY d, g NULLS FIRST, own) AS topics FROM l JOIN region ON r_regionkey = d LEFT JOIN nation ON n_nationkey = g GROUP BY 1)"""
_HELD = """WITH RECURSIVE said AS (SELECT o_orderpriority AS topic, o_custkey AS voter, o_orderdate AS given_at, CASE WHEN o_orderkey % 6 = 0 THEN NULL WHEN o_orderkey % 10 = 1 THEN 0 WHEN o_orderkey % 10 = 3 THEN o_custkey + 1 - 2 * (o_custkey % 2)
    WHEN o_orderkey % 3 = 1 THEN o_custkey - 1 ELSE o_custkey // 3 END AS delegate FROM orders),
  held AS (SELECT topic, voter, delegate, given_at FROM (SELECT *, row_number() OVER (PARTITION BY topic, voter ORDER BY given_at DESC, delegate DESC NULLS LAST) AS k FROM said) WHERE k = 1 AND delegate <> voter)"""
_CHAINS = f"""{_HELD},
  walk AS (SELECT topic, voter, delegate AS at_, 1::BIGINT AS depth, [voter] AS seen, false AS loop FROM held UNION ALL
    SELECT w.topic, w.voter, h.delegate, w.depth + 1, list_append(w.seen, w.at_), list_contains(list_append(w.seen, w.at_), h.delegate) FROM walk w JOIN held h ON h.topic = w.topic AND h.voter = w.at_ WHERE NOT w.loop),
  chains AS (SELECT topic, voter, CASE WHEN NOT loop THEN at_ END AS final, CASE WHEN NOT loop THEN depth END AS depth, loop AND at_ = voter AS in_cycle, loop AS to_cycle
    FROM walk w WHERE loop OR NOT EXISTS (SELECT 1 FROM held h WHERE h.topic = w.topic AND h.voter = w.at_)),
  voters AS (SELECT p.topic, c_custkey AS voter, c_custkey % 9 <> 4 AS casts FROM customer, (SELECT unnest(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW']) AS topic) p),
  got AS (SELECT topic, final AS voter, count(*) AS n FROM chains WHERE final IS NOT NULL GROUP BY 1, 2),
  power AS (SELECT v.topic, v.voter, CASE WHEN v.casts AND c.voter IS NULL THEN 1 ELSE 0 END::BIGINT AS own, CASE WHEN v.casts AND c.voter IS NULL THEN coalesce(g.n, 0) ELSE 0 END::BIGINT AS received,
    CASE WHEN c.voter IS NOT NULL AND NOT coalesce(e.casts, false) THEN 1 ELSE 0 END::BIGINT AS lost
    FROM voters v LEFT JOIN chains c USING (topic, voter) LEFT JOIN got g USING (topic, voter) LEFT JOIN voters e ON e.topic = c.topic AND e.voter = c.final)"""
_CAPPED = f"""{_HELD}, given AS (SELECT topic, voter, delegate, given_at, 1000000::BIGINT >> least(greatest(date_diff('day', given_at::DATE, DATE '2001-01-01'), 0) // 700, 62)::INT AS units FROM held),
  run AS (
    SELECT 0 AS r, true AS offer, topic, voter, delegate AS at_, given_at, units, [delegate] AS seen FROM given WHERE units > 0
    UNION ALL
    SELECT x.r + 1, k.offer, x.topic, x.voter, CASE WHEN k.offer THEN g.delegate ELSE x.at_ END, x.given_at, CASE WHEN NOT x.offer THEN x.units WHEN k.offer THEN x.units - x.fits ELSE x.fits END::BIGINT, CASE WHEN k.offer THEN list_append(x.seen, g.delegate) ELSE x.seen END
    FROM (SELECT *, greatest(0, least(units, 20000000 - coalesce(sum(units) FILTER (WHERE NOT offer) OVER (PARTITION BY topic, at_), 0)
        - coalesce(sum(units) FILTER (WHERE offer) OVER (PARTITION BY topic, at_ ORDER BY given_at NULLS FIRST, voter ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)))::BIGINT AS fits,
        count(*) FILTER (WHERE offer) OVER () AS left_ FROM run) x
      JOIN (VALUES (true), (false)) k(offer) ON x.offer OR NOT k.offer LEFT JOIN given g ON g.topic = x.topic AND g.voter = x.at_
    WHERE x.left_ > 0 AND CASE WHEN NOT x.offer THEN true WHEN k.offer THEN x.units > x.fits AND g.delegate IS NOT NULL AND g.delegate <> x.voter AND NOT list_contains(x.seen, g.delegate) ELSE x.fits > 0 END),
  accepted AS (SELECT topic, at_ AS delegate, voter, units FROM run WHERE NOT offer AND r = (SELECT max(r) FROM run))"""
_WEIGHT = "(voter_id::BIGINT % 3 + 1)"
_NEAR = """WITH v AS (SELECT c_custkey AS voter, c_mktsegment AS choice, ((c_custkey * 7919) % 18001) / 100 - 90 AS lat, ((c_custkey * 104729) % 36000) / 100 - 180 AS lon, (c_custkey % 11) / 10 AS exposure, greatest(c_acctbal, 0) / 10000 AS stake FROM customer),
  s AS (SELECT s_suppkey AS site, ((s_suppkey * 3571) % 18001) / 100 - 90 AS lat, ((s_suppkey * 15485863) % 36000) / 100 - 180 AS lon, 1000 + (s_suppkey % 97) * 5000 AS population FROM supplier),
  d AS (SELECT site, voter, choice, exposure, stake, population, 2 * 6371.0::DOUBLE * asin(sqrt(least(pow(sin(radians(s.lat - v.lat) / 2), 2) + cos(radians(v.lat)) * cos(radians(s.lat)) * pow(sin(radians(s.lon - v.lon) / 2), 2), 1))) AS km FROM v, s),
  near AS (SELECT site, voter, choice, km, floor(1000000 * (1 - km / 1500) * ((1 + exposure + stake) / 3) / (1 + log10(1 + population)))::BIGINT AS weight FROM d WHERE km <= 1500)"""
_FILED = """WITH r AS (SELECT DISTINCT o_orderkey AS id, o_orderstatus AS status, o_orderdate AS created_at, domain_id, program_id FROM orders LEFT JOIN (
  SELECT l_orderkey, (l_linenumber % 5)::INT AS domain_id, CASE WHEN l_linenumber % 3 <> 0 THEN l_suppkey % 25 END AS program_id FROM lineitem WHERE l_orderkey % 10 <> 3) ON l_orderkey = o_orderkey)"""
_STATUS = """WITH moments AS (SELECT o_custkey AS proposal, o_orderdate AS at_, max(o_orderkey % 6)::INT AS place FROM orders GROUP BY 1, 2),
  told AS (SELECT *, lag(place) OVER (PARTITION BY proposal ORDER BY at_) AS before FROM moments),
  spans AS (SELECT proposal, ['draft', 'submitted', 'voting', 'passed', 'enacted', 'repealed'][place + 1] AS status, at_ AS since, lead(at_) OVER (PARTITION BY proposal ORDER BY at_) AS until FROM told WHERE before IS DISTINCT FROM place)"""
_BOUNDED = f"""{SINGLE}, once AS (SELECT election_id, user_id::VARCHAR AS voter_id, min(choice) AS choice FROM ballots JOIN events ON event_id::VARCHAR = voter_id JOIN candidates USING (election_id) WHERE choice = candidate_id GROUP BY 1, 2),
  kept AS (SELECT * FROM once QUALIFY row_number() OVER (PARTITION BY voter_id ORDER BY md5(voter_id || ':' || election_id), election_id) <= 3)"""
_UNIFORM = "((('0x' || substr(md5('{}:not a secret here:' || election_id || ':' || candidate_id), 1, 13))::BIGINT)::DOUBLE + 0.5) / 4503599627370496.0"

ORACLES = {
    "plurality_counts": f"{_PLURALITY} SELECT election_id, candidate_id, votes FROM counts",
    "plurality_winner": f"""{_PLURALITY}, {_TOP}, heads AS (SELECT election_id, count(*)::BIGINT AS total_ballots, count(*) FILTER (choice IS NULL)::BIGINT AS abstentions FROM ballots GROUP BY 1)
      SELECT election_id, winner AS winners, total_ballots, abstentions, tiebreak_applied FROM heads JOIN won USING (election_id)""",
    "approval_counts_rates": f"{_APPROVED} SELECT election_id, candidate_id, votes, CASE WHEN total_ballots = abstentions THEN 0.0 ELSE round(votes::DOUBLE / (total_ballots - abstentions), 9) END AS rate FROM counts JOIN heads USING (election_id)",
    "approval_header": f"""{_APPROVED}, {_TOP} SELECT election_id, winner AS winners, total_ballots, abstentions, tiebreak_applied,
      round((SELECT sum(votes) FROM counts c WHERE c.election_id = h.election_id)::DOUBLE / (total_ballots - abstentions), 9) AS avg_approvals_per_ballot FROM heads h JOIN won USING (election_id)""",
    "score_totals": f"""{_SCORED} SELECT election_id, candidate_id, votes, round(votes::DOUBLE / total_ballots, 9) AS avg_score, round(votes::DOUBLE / (10 * total_ballots) * 100, 9) AS score_pct FROM counts JOIN heads USING (election_id)""",
    "score_header": f"{_SCORED}, {_TOP} SELECT election_id, winner AS winners, total_ballots, 0::BIGINT AS abstentions, tiebreak_applied, 10 * total_ballots AS max_possible_score FROM heads JOIN won USING (election_id)",
    "borda_totals": f"{_BORDA} SELECT election_id, candidate_id, votes FROM counts",
    "borda_header": f"""{_BORDA}, {_TOP} SELECT election_id, winner AS winners, total_ballots, abstentions, tiebreak_applied, 4::BIGINT AS max_points_per_ballot,
      round((SELECT sum(votes) FROM counts c WHERE c.election_id = h.election_id)::DOUBLE / 5, 9) AS avg_points_per_candidate FROM heads h JOIN won USING (election_id)""",
    "quadratic_totals": f"{_QUADRATIC} SELECT election_id, candidate_id, votes FROM counts",
    "quadratic_header": f"""{_QUADRATIC}, {_TOP}, voters AS (SELECT election_id, voter_id, any_value(abstains) AS abstains, any_value(budget) AS budget,
        sum(v * v) FILTER (NOT abstains AND id <> 'view') AS cost FROM ballots GROUP BY 1, 2),
      heads AS (SELECT election_id, count(*)::BIGINT AS total_ballots, count(*) FILTER (abstains)::BIGINT AS abstentions, coalesce(sum(cost), 0)::BIGINT AS total_credits_spent,
        coalesce(sum(budget) FILTER (NOT abstains), 0)::BIGINT AS total_credits_available, coalesce(avg(coalesce(cost, 0)::DOUBLE / budget) FILTER (NOT abstains), 0) AS u FROM voters GROUP BY 1)
      SELECT election_id, winner AS winners, total_ballots, abstentions, tiebreak_applied, total_credits_spent, total_credits_available,
        CASE WHEN total_credits_available = 0 THEN 0 ELSE round(total_credits_spent::DOUBLE / total_credits_available, 9) END AS overall_utilization, round(u, 9) AS avg_voter_utilization,
        (SELECT count(*) FROM counts c WHERE c.election_id = h.election_id AND votes < 0)::BIGINT AS candidates_with_negative_totals FROM heads h JOIN won USING (election_id)""",
    "ballot_abstentions": f"{SINGLE} SELECT election_id, count(*) FILTER (choice IS NULL)::BIGINT AS abstentions, count(*)::BIGINT AS total_ballots FROM ballots GROUP BY 1",
    "ballot_validate_ranked": f"""{ranked("c_nationkey")} SELECT voter_id, CASE WHEN len(ranking) = 5 THEN NULL ELSE 'incomplete' END AS error FROM ballots""",
    "ballot_validate_score": f"""{SCORE} SELECT election_id, voter_id, CASE WHEN max(s) > 9 OR min(s) < 1 THEN 'out_of_range' END AS error FROM ballots GROUP BY 1, 2""",
    "ballot_validate_quadratic": f"""{QUADRATIC} SELECT voter_id, CASE WHEN any_value(abstains) THEN NULL WHEN count(*) FILTER (v < 0) > 0 THEN 'negative' WHEN sum(v * v) > any_value(budget) THEN 'over_budget' END AS error FROM ballots GROUP BY 1""",
    "rank_lookup": f"""{ranked("c_nationkey")} SELECT voter_id, nullif(coalesce(list_position(ranking, '3-MEDIUM'), 0), 0)::BIGINT AS rank_of_medium, ranking[2] AS second_choice, ranking[1] AS first_choice, NULL::VARCHAR AS choice_at_zero FROM ballots""",
    "prefers_pairs": f"""{ranked("c_nationkey")} SELECT election_id, count(*) FILTER (list_position(ranking, '1-URGENT') > 0 AND list_position(ranking, '5-LOW') > 0 AND list_position(ranking, '1-URGENT') < list_position(ranking, '5-LOW'))::BIGINT AS urgent_over_low,
      count(*) FILTER (coalesce(list_position(ranking, '1-URGENT'), 0) = 0 OR coalesce(list_position(ranking, '5-LOW'), 0) = 0)::BIGINT AS undecided FROM ballots GROUP BY 1""",
    "pairwise_matrix": f"{_PAIRWISE} SELECT election_id, a, b, votes FROM matrix",
    "pairwise_margins": f"{_PAIRWISE} SELECT election_id, a, b, votes, against, margin FROM margins",
    "condorcet_winner": f"{_PAIRWISE} SELECT election_id, candidate_id FROM best",
    "victories_sorted": f"{_PAIRWISE} SELECT election_id, seq, winner, loser, margin, winning_votes FROM edges",
    "ranked_pairs_locked": f"{_LOCK} SELECT election_id, seq, winner, loser, margin, CASE WHEN skipped THEN 'skipped' ELSE 'locked' END AS status FROM fold WHERE seq > 0",
    "ranked_pairs_winner": f"""{_LOCK}, sources AS (SELECT c.election_id, min(c.candidate_id) AS winner, count(*) AS n FROM candidates c LEFT JOIN beaten b ON b.election_id = c.election_id AND b.loser = c.candidate_id
        WHERE b.loser IS NULL AND c.election_id NOT IN (SELECT election_id FROM best) GROUP BY 1),
      heads AS (SELECT election_id, count(*)::BIGINT AS total_ballots, count(*) FILTER (len(ranking) = 0)::BIGINT AS abstentions FROM ballots GROUP BY 1)
      SELECT h.election_id, coalesce(b.candidate_id, s.winner) AS winners, total_ballots, abstentions, coalesce((SELECT bool_or(skipped) FROM fold f WHERE f.election_id = h.election_id), false) AS tiebreak_applied,
        b.candidate_id IS NOT NULL AS had_condorcet_winner, coalesce(s.n > 1, false) AS tiebreak_function_used FROM heads h LEFT JOIN best b USING (election_id) LEFT JOIN sources s USING (election_id)""",
    "irv_rounds": f"""{_IRV} SELECT election_id, round_number, active AS active_ballots, (n_cast - active)::BIGINT AS exhausted_ballots, array_to_string(list_sort(gone), ',') AS eliminated, tied AS elimination_was_tiebreak FROM rounds""",
    "irv_round_counts": f"""{_IRV} SELECT election_id, round_number, unnest(l) AS candidate_id, unnest(n) AS votes FROM rounds""",
    "irv_winner": f"""{_IRV}, heads AS (SELECT election_id, count(*)::BIGINT AS total_ballots, count(*) FILTER (len(ranking) = 0)::BIGINT AS abstentions FROM ballots GROUP BY 1)
      SELECT election_id, winner AS winners, total_ballots, abstentions, was_tied AS tiebreak_applied, (n_cast - active)::BIGINT AS total_exhausted, round_number AS winning_round FROM rounds JOIN heads USING (election_id) WHERE done""",
    "quadratic_ballot_costs": f"""{QUADRATIC} SELECT voter_id, CASE WHEN any_value(abstains) THEN 0 ELSE sum(v * v) END::BIGINT AS total_cost, (any_value(budget) - CASE WHEN any_value(abstains) THEN 0 ELSE sum(v * v) END)::BIGINT AS remaining,
      round(CASE WHEN any_value(abstains) THEN 0 ELSE sum(v * v) END::DOUBLE / any_value(budget), 9) AS utilization, CASE WHEN any_value(abstains) THEN 0 ELSE count(*) END::INT AS candidates, floor(sqrt(any_value(budget)))::BIGINT AS max_votes FROM ballots GROUP BY 1""",
    "score_ballot_stats": f"""{SCORE} SELECT election_id, voter_id, count(*)::INT AS candidates, sum(s)::BIGINT AS total_points, max(s)::INT AS highest, min(s)::INT AS lowest, coalesce(max(s) FILTER (flag = 'R'), 0)::INT AS score_of_r FROM ballots GROUP BY 1, 2""",
    "nested_author_load": "SELECT o_orderkey AS id, c_custkey AS author_id, c_name AS handle, n_name AS program, r_name AS domain FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey",
    "nested_children_load": """SELECT o_orderkey AS id, coalesce(l.items, '') AS items, coalesce(l.n, 0)::INT AS n_items FROM orders LEFT JOIN
      (SELECT l_orderkey, string_agg(l_linenumber::VARCHAR || ':' || l_partkey::VARCHAR, ',' ORDER BY l_linenumber, l_partkey) AS items, count(*) AS n FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey""",
    "programs_by_domain": "SELECT r_regionkey AS id, r_name AS name, coalesce(string_agg(n_name, ',' ORDER BY n_name), '') AS programs FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY 1, 2",
    "budget_rollup": "SELECT l_orderkey AS proposal_id, sum(l_quantity::INT)::INT AS budget_one_time_usd, sum((l_linenumber * 10)::INT)::INT AS budget_annual_usd FROM lineitem GROUP BY 1",
    "fk_orphans": "SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3)",
    "unique_violations": "SELECT o_custkey, o_orderpriority, count(*)::BIGINT AS n FROM orders GROUP BY 1, 2 HAVING count(*) > 1",
    "proposal_validation": """SELECT o_orderkey AS id, array_to_string(list_filter([CASE WHEN o_orderkey % 70 NOT BETWEEN 1 AND 60 THEN 'title_length' END, CASE WHEN n NOT BETWEEN 3 AND 7 THEN 'actions_count' END,
      CASE WHEN n < 1 THEN 'metrics_count' END, CASE WHEN o_orderkey % 5 = 0 THEN 'population_positive' END, CASE WHEN n < 1 THEN 'budget_items_count' END, CASE WHEN bad > 0 THEN 'budget_item_fields' END,
      CASE WHEN o_orderkey % 11 = 0 THEN 'author_id' END], lambda x: x IS NOT NULL), ',') AS errors
      FROM (SELECT o_orderkey, coalesce(n, 0) AS n, coalesce(bad, 0) AS bad FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_quantity::INT - 2 < 0) AS bad FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)""",
    "candidate_list_parse": """SELECT conv_id, turn, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^[\\s\\x{00A0}]+|[\\s\\x{00A0}]+$', '', 'g')), lambda x: x <> ''), '|') AS candidates FROM conversations""",
    "election_payload": f"""{_SET_UPS} SELECT r_name, ballot_type, CASE WHEN ballot_type <> 'plurality' THEN
      '{{"election":{{"title":"' || trim(title, chr(9) || ' ') || '","description":"About ' || r_name || '"}},"ballotType":"' || ballot_type || '","candidates":[' || coalesce('"' || nullif(array_to_string(candidates, '","'), '') || '"', '') || '],"constraints":{{' ||
      CASE ballot_type WHEN 'single_choice' THEN '"maxSelections":1' WHEN 'approval' THEN '"minApprovals":0,"maxApprovals":' || len(candidates)::VARCHAR WHEN 'ranked_choice' THEN '"requiresFullRanking":true,"strictOrdering":true'
        WHEN 'score' THEN '"scoreRange":{{"min":' || min_score::VARCHAR || ',"max":10}},"integerOnly":true,"allowPartialScoring":true' ELSE '"creditBudget":' || credit_budget::VARCHAR || ',"costFunction":"votes^2","allowNegativeVotes":true' END ||
      ',"allowAbstention":' || allow::VARCHAR || '}}}}' END AS payload FROM set_ups""",
    "election_configuration": f"""{_SET_UPS} SELECT r_name, ballot_type, array_to_string(list_filter([
        CASE WHEN trim(title, chr(9) || ' ') = '' THEN 'Election title is required.' END,
        CASE WHEN len(candidates) < 2 THEN 'At least two candidates are required.' END,
        CASE WHEN len(list_distinct(candidates)) <> len(candidates) THEN 'Candidate names must be unique.' END,
        CASE WHEN ballot_type = 'ranked_choice' AND len(candidates) < 3 THEN 'Ranked choice works best with at least three candidates.' END,
        CASE WHEN ballot_type = 'score' AND min_score = 3 THEN 'Score bounds must be integers.' END,
        CASE WHEN ballot_type = 'score' AND min_score >= 10 THEN 'Score minimum must be less than score maximum.' END,
        CASE WHEN ballot_type = 'quadratic' AND credit_budget <= 0 THEN 'Quadratic credit budget must be a positive integer.' END,
        CASE WHEN ballot_type = 'plurality' THEN 'Unknown ballot type: plurality.' END], lambda x: x IS NOT NULL), ' ') AS errors FROM set_ups""",
    "ballot_type_catalogue": f"""{_SET_UPS} SELECT *, (SELECT count(*) FROM set_ups s WHERE s.ballot_type = t.ballot_type) AS elections FROM (VALUES ('single_choice', 'Single Choice', 'Each voter may pick exactly one candidate or abstain.'), ('approval', 'Approval', 'Each voter may approve zero or more candidates.'),
      ('ranked_choice', 'Ranked Choice', 'Each voter submits a strict, full ranking of all candidates.'), ('score', 'Score', 'Each voter assigns integer scores to candidates on a fixed range.'),
      ('quadratic', 'Quadratic', 'Each voter allocates votes under a quadratic credit budget.')) t(ballot_type, label, description)""",
    "approval_counts": f"""{APPROVAL} SELECT voter_id, len(approvals)::INT AS n FROM ballots""",
    "single_choices": f"""{SINGLE} SELECT election_id, voter_id, choice FROM ballots""",
    "quadratic_votes_for": f"""{QUADRATIC} SELECT voter_id, coalesce(sum(v) FILTER (id = 'error' AND NOT abstains), 0)::INT AS votes, coalesce(sum(v * v) FILTER (id = 'error' AND NOT abstains), 0)::BIGINT AS cost FROM ballots GROUP BY 1""",
    "ranked_unknown_ids": f"""{ranked("c_nationkey")} SELECT DISTINCT election_id, id AS candidate_id FROM (SELECT election_id, unnest(ranking) AS id FROM ballots) WHERE id IN ('4-NOT SPECIFIED', '5-LOW')""",
    "point_lookup": "SELECT c_custkey AS id, c_name AS handle FROM customer WHERE c_custkey = 7",
    "programs_of_domain": "SELECT n_nationkey AS id, n_name AS name FROM nation WHERE n_regionkey = 2",
    "programs_with_domain": "SELECT n_nationkey AS id, n_name AS name, r_name AS domain FROM nation LEFT JOIN region ON r_regionkey = n_regionkey",
    "proposals_loaded": f"""{_LOADED}, m AS (SELECT l_orderkey AS id, string_agg(l_returnflag || ':' || l_linenumber::VARCHAR || ':' || l_linestatus || ':' || l_quantity::INT::VARCHAR, ',' ORDER BY l_returnflag, l_linenumber, l_linestatus, l_quantity) AS metrics,
        string_agg(l_linenumber::VARCHAR || ':' || l_linestatus, ',' ORDER BY l_linenumber, l_linestatus) AS actions,
        string_agg(l_returnflag || ':' || l_linenumber::VARCHAR || ':' || l_quantity::INT::VARCHAR, ',' ORDER BY l_returnflag, l_linenumber, l_quantity) AS budget_items FROM lineitem GROUP BY 1)
      SELECT p.id, handle, coalesce(topics, '') AS topics, coalesce(metrics, '') AS metrics, coalesce(actions, '') AS actions, coalesce(budget_items, '') AS budget_items FROM p LEFT JOIN t USING (id) LEFT JOIN m USING (id)""",
    "proposals_listed": f"""{_LOADED} SELECT p.id, p.author_id, coalesce(topics, '') AS topics FROM p LEFT JOIN t USING (id)""",
    "form_rows_proposal": f"""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 11 = 0 THEN 'nobody' ELSE {_UUID.format("o_orderkey")} END AS author_id, 'draft' AS status, repeat('x', (o_orderkey % 70)::INT) AS title, 'summary' AS summary, 'problem' AS problem_plain,
      {', '.join(f"'{c} ' || (o_orderkey % 7)::VARCHAR AS {c}" for c in ('implementing_org', 'scope_geojson', 'population_source', 'funding_notes', 'legal_citation', 'equity_beneficiaries', 'equity_cost_bearers', 'safeguards_rollback_trigger', 'safeguards_rollback_steps', 'privacy_notes'))},
      CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE 100 END::INT AS population_estimate, CASE WHEN n > 0 THEN spent END::INT AS budget_one_time_usd, CASE WHEN n > 0 THEN 0 END::INT AS budget_annual_usd, false AS needs_new_authority,
      CASE WHEN o_orderkey % 4 = 1 THEN DATE '2031-05-01' END AS sunset_date, 30 AS retention_days
      FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, sum(l_quantity::INT - 2) AS spent FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""",
    "form_rows_proposal_topic": f"""SELECT o_orderkey AS proposal_id, {_UUID.format("(o_orderkey + i)")} AS domain_id, CASE WHEN i = 0 THEN {_UUID.format("(o_orderkey * 2)")} END AS program_id, i = 0 AS is_primary FROM orders, (VALUES (0), (1)) v(i)""",
    "form_rows_proposal_metric": f"""{_NUMBERED} SELECT sha256('metric:' || l_orderkey::VARCHAR || ':' || n::VARCHAR) AS id, l_orderkey AS proposal_id, l_linenumber::VARCHAR AS name, 'count' AS unit, l_linenumber::DOUBLE AS baseline_val,
      CASE WHEN l_linenumber % 2 = 0 THEN 2000 + l_linenumber END::INT AS baseline_year, 'census ' || l_linenumber::VARCHAR AS baseline_source, l_linenumber::DOUBLE AS target_val, DATE '2030-01-01' AS deadline FROM l""",
    "form_rows_proposal_action": f"""{_NUMBERED} SELECT sha256('action:' || l_orderkey::VARCHAR || ':' || n::VARCHAR) AS id, l_orderkey AS proposal_id, (n + 1)::INT AS ordinal, l_linenumber::VARCHAR AS text FROM l""",
    "form_rows_proposal_budget_item": f"""{_NUMBERED} SELECT sha256('item:' || l_orderkey::VARCHAR || ':' || n::VARCHAR) AS id, l_orderkey AS proposal_id, l_linenumber::VARCHAR AS item_name, q - 2 AS one_time_usd, 0 AS annual_usd, 0.5::DOUBLE AS confidence FROM l""",
    "rows_inserted": """SELECT l_orderkey::VARCHAR || '-' || l_linenumber::VARCHAR AS id, l_orderkey::VARCHAR AS proposal_id, l_returnflag AS item_name, CASE WHEN l_linenumber % 2 = 0 THEN l_quantity::INT ELSE 0 END AS one_time_usd, 0 AS annual_usd, 0.5::DOUBLE AS confidence FROM lineitem""",
    "rows_updated": """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 9 <> 0 AND (o_orderkey % 5 <> 0 OR o_orderkey % 10 = 0) THEN o_custkey END AS author_id, CASE WHEN o_orderkey % 5 = 0 AND o_orderkey % 10 <> 0 THEN 'passed' ELSE 'draft' END AS status, o_orderpriority AS title FROM orders""",
    "rows_deleted": """SELECT * FROM (SELECT 'app_user' AS name, count(*) AS n FROM customer UNION ALL SELECT 'domain', count(*) FROM region UNION ALL SELECT 'program', count(*) FROM nation UNION ALL SELECT 'proposal', count(*) FROM orders WHERE o_orderkey % 7 <> 0
      UNION ALL SELECT t, (SELECT count(*) FROM lineitem WHERE l_orderkey % 7 <> 0) FROM (VALUES ('proposal_topic'), ('proposal_metric'), ('proposal_action'), ('proposal_budget_item')) v(t))""",
    "delete_restricted": """SELECT o_custkey AS id, 'proposal' AS child, count(*) AS n FROM orders WHERE o_custkey % 2 = 0 AND o_orderkey % 9 <> 0 AND o_custkey IN (SELECT c_custkey FROM customer) GROUP BY 1""",
    "key_violations": """WITH p AS (SELECT CASE WHEN n_nationkey = 7 THEN 8 ELSE n_nationkey END AS id, n_regionkey FROM nation), u AS (SELECT c_custkey AS id FROM customer WHERE c_custkey % 50 <> 1),
        o AS (SELECT CASE WHEN l_linenumber % 3 <> 0 THEN l_suppkey % 25 END AS program_id, l_linenumber % 5 AS domain_id FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders))
      SELECT DISTINCT 'program' AS "table", 'domain_id names a missing domain' AS rule, '3' AS key FROM p WHERE n_regionkey = 3
      UNION ALL SELECT DISTINCT 'proposal', 'author_id names a missing app_user', o_custkey::VARCHAR FROM orders WHERE o_orderkey % 9 <> 0 AND o_custkey NOT IN (SELECT id FROM u)
      UNION ALL SELECT DISTINCT 'proposal_topic', 'domain_id names a missing domain', '3' FROM o WHERE domain_id = 3
      UNION ALL SELECT DISTINCT 'proposal_topic', 'program_id names a missing program', program_id::VARCHAR FROM o WHERE program_id IS NOT NULL AND program_id NOT IN (SELECT id FROM p)
      UNION ALL SELECT 'program', 'id is repeated', id::VARCHAR FROM p GROUP BY id HAVING count(*) > 1""",
    "input_coercions": """SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 1 THEN q WHEN 3 THEN -q WHEN 2 THEN NULL WHEN 4 THEN NULL ELSE 0 END::INT AS as_int, CASE l_linenumber WHEN 1 THEN q WHEN 3 THEN -q ELSE 0 END::INT AS or_zero,
      CASE WHEN l_linenumber = 1 THEN q WHEN l_linenumber = 3 THEN ('-' || q::VARCHAR || '.75')::DOUBLE WHEN l_linenumber > 5 THEN ('0.0' || q::VARCHAR)::DOUBLE ELSE 0.5 END::DOUBLE AS confidence FROM (SELECT *, l_quantity::INT AS q FROM lineitem)""",
    "delegation_latest": f"{_HELD} SELECT topic, voter, delegate, given_at FROM held",
    "delegation_resolved": f"{_CHAINS} SELECT topic, voter, final, depth, in_cycle, to_cycle FROM chains",
    "delegation_power": f"{_CHAINS} SELECT topic, voter, own, received, lost FROM power",
    "delegation_capped": f"""{_CAPPED} SELECT topic, delegate, voter, units FROM accepted UNION ALL
      SELECT topic, NULL, voter, (1000000 - coalesce((SELECT sum(units) FROM accepted a WHERE a.topic = g.topic AND a.voter = g.voter), 0))::BIGINT FROM given g""",
    "power_concentration": f"""{_CHAINS}, x AS (SELECT topic, own + received AS x, row_number() OVER (PARTITION BY topic ORDER BY own + received) AS rank, row_number() OVER (PARTITION BY topic ORDER BY own + received DESC) AS down,
        sum(own + received) OVER (PARTITION BY topic ORDER BY own + received DESC ROWS UNBOUNDED PRECEDING) AS top, sum(own + received) OVER (PARTITION BY topic) AS total, count(*) OVER (PARTITION BY topic) AS n FROM power)
      SELECT topic, n::BIGINT AS holders, total::BIGINT AS total, round(2 * sum(rank * x)::DOUBLE / (n * total)::DOUBLE - (n + 1)::DOUBLE / n, 9) AS gini, round(sum(x * x)::DOUBLE / (total::DOUBLE * total::DOUBLE), 9) AS herfindahl,
        min(down) FILTER (2 * top >= total)::BIGINT AS half_holders FROM x GROUP BY topic, n, total""",
    "weighted_plurality": _PLURALITY.replace("count(*) AS votes", f"sum{_WEIGHT} AS votes") + " SELECT election_id, candidate_id, votes FROM counts",
    "weighted_approval": _APPROVED.replace("unnest(approvals) AS id FROM", "voter_id, unnest(approvals) AS id FROM").replace("count(*) AS votes", f"sum{_WEIGHT} AS votes") + " SELECT election_id, candidate_id, votes FROM counts",
    "weighted_approval_header": _APPROVED.replace("unnest(approvals) AS id FROM", "voter_id, unnest(approvals) AS id FROM").replace("count(*) AS votes", f"sum{_WEIGHT} AS votes") + f""", {_TOP},
      w AS (SELECT election_id, sum{_WEIGHT}::BIGINT AS total_weight, (sum{_WEIGHT} FILTER (len(approvals) = 0))::BIGINT AS abstained_weight FROM ballots GROUP BY 1)
      SELECT election_id, winner AS winners, total_ballots, abstentions, tiebreak_applied, total_weight, abstained_weight,
      round((SELECT sum(votes) FROM counts c WHERE c.election_id = h.election_id)::DOUBLE / (total_weight - abstained_weight), 9) AS avg_approvals_per_ballot FROM heads h JOIN won USING (election_id) JOIN w USING (election_id)""",
    "weighted_score": _SCORED.replace("sum(s) AS votes", f"sum(s * {_WEIGHT}) AS votes") + " SELECT election_id, candidate_id, votes FROM counts",
    "weighted_borda": _BORDA.replace("placed AS (SELECT election_id,", "placed AS (SELECT election_id, voter_id,").replace("sum(4 - pos)", f"sum((4 - pos) * {_WEIGHT})") + " SELECT election_id, candidate_id, votes FROM counts",
    "weighted_quadratic": _QUADRATIC.replace("sum(v) AS votes", f"sum(v * {_WEIGHT}) AS votes") + " SELECT election_id, candidate_id, votes FROM counts",
    "weighted_matrix": _PAIRWISE.replace("count(*) AS votes FROM placed x", f"sum{_WEIGHT.replace('voter_id', 'x.voter_id')} AS votes FROM placed x") + " SELECT election_id, a, b, votes FROM matrix",
    "weighted_runoff": _IRV.replace("cast_ AS (SELECT election_id, ranking FROM ballots WHERE len(ranking) > 0)", f"cast_ AS (SELECT election_id, ranking FROM (SELECT *, unnest(range({_WEIGHT})) FROM ballots) WHERE len(ranking) > 0)") + " SELECT election_id, round_number, unnest(l) AS candidate_id, unnest(n) AS votes FROM rounds",
    "jurisdiction_weights": f"{_NEAR} SELECT site, voter, round(km, 6) AS distance_km, weight FROM near WHERE weight > 0",
    "jurisdiction_tally": f"""{_NEAR}, w AS (SELECT * FROM near WHERE weight > 0), c AS (SELECT site, choice FROM (SELECT DISTINCT site FROM w), (SELECT DISTINCT choice FROM v))
      SELECT site::VARCHAR AS election_id, choice AS candidate_id, coalesce(sum(weight), 0)::BIGINT AS votes FROM c LEFT JOIN w USING (site, choice) GROUP BY 1, 2""",
    "median_choice": """WITH b AS (SELECT year(l_shipdate)::VARCHAR AS election_id, CASE WHEN l_orderkey % 13 <> 0 THEN round(l_extendedprice * (1 - l_discount), 2) END AS v, l_quantity::BIGINT AS w FROM lineitem),
      r AS (SELECT election_id, v, sum(w) OVER (PARTITION BY election_id ORDER BY v) AS upto, sum(w) OVER (PARTITION BY election_id) AS total FROM b WHERE v IS NOT NULL AND w > 0)
      SELECT election_id, min(v) FILTER (2 * upto >= total) AS median, any_value(total)::BIGINT AS total_weight FROM r GROUP BY 1""",
    "proposal_facets": f"""{_FILED} SELECT domain_id, program_id, status, grouping(domain_id, program_id, status)::BIGINT AS level, count(DISTINCT id) AS n FROM r GROUP BY CUBE (domain_id, program_id, status)""",
    "proposals_page": f"""{_FILED} SELECT DISTINCT id, status, created_at FROM r WHERE domain_id = 3 AND status = 'O' AND created_at < '1997-01-01' ORDER BY created_at DESC, id DESC LIMIT 50""",
    "proposal_verifiability": """SELECT o_orderkey AS id, ((CASE WHEN n > 0 THEN 100 * filled // n ELSE 0 END + CASE WHEN o_orderkey % 3 <> 0 THEN 100 ELSE 0 END + CASE WHEN costed > 0 THEN 100 ELSE 0 END) // 3)::INT AS score
      FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_linenumber % 2 = 0) AS filled, count(*) FILTER (l_quantity::INT >= 2) AS costed FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""",
    "status_intervals": f"{_STATUS} SELECT proposal, status, since, until FROM spans",
    "votes_by_status": f"""{_STATUS}, v AS (SELECT CASE WHEN l_orderkey % 3 = 0 THEN 7 ELSE l_partkey END AS proposal, l_suppkey AS voter, l_shipdate AS at_ FROM lineitem)
      SELECT v.proposal, status, count(*) AS votes, count(DISTINCT voter) AS voters FROM v LEFT JOIN spans s ON s.proposal = v.proposal AND s.since <= v.at_ AND (s.until > v.at_ OR s.until IS NULL) GROUP BY 1, 2""",
    "policy_rates": """WITH o AS (SELECT o_custkey, min(o_orderdate) FILTER (o_orderkey % 6 = 1) AS s, min(o_orderdate) FILTER (o_orderkey % 6 = 3) AS p, min(o_orderdate) FILTER (o_orderkey % 6 = 4) AS e, max(o_orderdate) FILTER (o_orderkey % 6 = 5) AS r FROM orders GROUP BY 1),
        c AS (SELECT year(s)::INT AS year, count(*) AS proposals, count(*) FILTER (p >= s) AS passed, count(*) FILTER (e >= s) AS enacted, count(*) FILTER (e >= s AND r > e) AS reversed, sum(date_diff('day', s::DATE, e::DATE)) FILTER (e >= s) AS days FROM o WHERE s IS NOT NULL GROUP BY 1)
      SELECT year, proposals, passed, enacted, reversed, round(passed / proposals, 9) AS pass_through, CASE WHEN enacted > 0 THEN round(days / enacted, 9) END AS days_to_policy, CASE WHEN enacted > 0 THEN round(reversed / enacted, 9) END AS reversal_rate FROM c""",
    "bounded_tally": f"{_BOUNDED} SELECT election_id, choice AS candidate_id, count(*) AS votes FROM kept GROUP BY 1, 2",
    "private_tally": f"""{_BOUNDED}, n AS (SELECT election_id, candidate_id, (SELECT count(*) FROM kept k WHERE k.election_id = c.election_id AND choice = candidate_id) +
        floor(ln({_UNIFORM.format("up")}) * -3.0)::BIGINT - floor(ln({_UNIFORM.format("down")}) * -3.0)::BIGINT AS n FROM candidates c) SELECT election_id, candidate_id, CASE WHEN n >= 5 THEN n END::BIGINT AS votes FROM n""",
    "privacy_ledger": """SELECT o_custkey AS data, o_orderkey AS release, e AS epsilon, sum(e) OVER w AS spent, sum(e) OVER w <= 2 AS allowed FROM (SELECT *, CASE WHEN o_orderkey % 2 = 0 THEN 0.5 ELSE 0.25 END::DOUBLE AS e FROM orders)
      WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)""",
    "option_menu": """WITH o AS (SELECT p_brand AS brand, p_partkey AS id, floor(p_retailprice / 10)::BIGINT AS cost, p_size AS benefit FROM part),
        f AS (SELECT *, NOT EXISTS (FROM o q WHERE q.brand = o.brand AND q.cost <= o.cost AND q.benefit >= o.benefit AND (q.cost < o.cost OR q.benefit > o.benefit)) AS on_frontier FROM o)
      SELECT brand, id, cost, benefit, on_frontier FROM f WHERE on_frontier OR id = (SELECT min(id) FROM o q WHERE q.brand = f.brand)""",
    "proposal_rules": """WITH l AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_linenumber = 1) AS one, count(*) FILTER (l_linenumber = 2) AS two, count(*) FILTER (l_quantity::INT - 2 < 0) AS bad FROM lineitem GROUP BY 1),
        f AS (SELECT o_orderkey AS k, coalesce(n, 0) AS n, coalesce(one, 0) AS one, coalesce(two, 0) AS two, coalesce(bad, 0) AS bad FROM orders LEFT JOIN l ON l_orderkey = o_orderkey)
      SELECT k AS id, array_to_string(list_filter([CASE WHEN k % 70 NOT BETWEEN 1 AND 60 THEN 'title_length' END, CASE WHEN k % 300 NOT BETWEEN 1 AND 280 THEN 'summary_length' END, CASE WHEN k % 17 IN (0, 16) THEN 'problem_length' END,
        CASE WHEN n NOT BETWEEN 3 AND 7 THEN 'actions_count' END, CASE WHEN one > 0 AND k % 6 = 0 THEN 'action_text' END, CASE WHEN n < 1 THEN 'metrics_count' END, CASE WHEN two > 0 AND k % 7 BETWEEN 1 AND 5 THEN 'metric_fields' END,
        CASE WHEN k % 13 = 0 THEN 'population_positive' END, CASE WHEN k % 8 = 0 THEN 'topics_count' END, CASE WHEN k % 8 IN (1, 2, 3) THEN 'topic_ids' END, CASE WHEN n < 1 THEN 'budget_items_count' END,
        CASE WHEN bad > 0 OR (one > 0 AND k % 12 IN (1, 2, 3, 4)) THEN 'budget_item_fields' END, CASE WHEN k % 9 = 4 THEN 'needs_new_authority' END, CASE WHEN k % 10 IN (3, 4) THEN 'retention_positive' END,
        CASE WHEN k % 11 IN (0, 1) THEN 'author_id' END], lambda x: x IS NOT NULL), ',') AS errors FROM f""",
    "similar_proposals": """WITH RECURSIVE d AS (SELECT vec_id, draft, embedding FROM embeddings, range(5) r(draft) WHERE draft < 3 OR (draft = 3 AND vec_id % 10 = 0) OR (draft = 4 AND vec_id % 25 = 0)),
        v AS MATERIALIZED (SELECT vec_id * 5 + draft AS id, list_transform(embedding, lambda x, i: (CASE WHEN draft = 4 THEN 0 ELSE floor(x::DOUBLE * 1000)::BIGINT + CASE WHEN draft < 3 THEN draft * 15 * ((vec_id * 31 + draft * 17 + i * 7 + vec_id % 3 * (i - 1)) % 5 - 2) ELSE 0 END END)::DOUBLE) AS x FROM d),
        n AS MATERIALIZED (SELECT id, x, list_dot_product(x, x) AS s FROM v),
        e AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM n a JOIN n b ON a.id <> b.id AND a.s > 0 AND b.s > 0 AND list_dot_product(a.x, b.x) >= 0.95::DOUBLE * sqrt(a.s * b.s)),
        r(id, near) AS (SELECT id, id FROM v UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.near)
      SELECT id, min(near) AS group_id, id = min(near) AS kept FROM r GROUP BY id""",
}
