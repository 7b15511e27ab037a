"""What the tables hold, and questions that work on them."""

TABLES = {
    "events": "facts, one row each, with a flag for retracted ones",
    "sessions": "one row for each session of an agent: when it ran, what it did, whether it is open",
    "turns": "from a human prompt to the agent's stop",
    "tool_calls": "a start and its end, paired by id or by order",
    "attempts": "the parts of a turn between failures, with outcome and successor",
    "handoffs": "work that went from one agent to another's session",
    "edges": "typed causal links with evidence",
    "signals": "requests to a human and what cleared them",
    "work_units": "turns that belong together, with phase and status",
    "commits": "commits and the HEAD move that shows them",
    "decisions": "changes of approach and human interventions",
    "corrections": "what people said about outcomes, and what became of it",
    "retractions": "what was taken back",
    "conflicts": "open units that edit the same path",
}
QUESTIONS = {
    "What failed last?": "SHOW FAILED ATTEMPTS LIMIT 20",
    "What was tried again?": "SHOW SUPERSEDED ATTEMPTS",
    "Which sessions of an agent are there?": "SHOW SESSIONS FOR provider=claude LIMIT 10",
    "Who touched a folder?": "SHOW TOOL CALLS FOR path='src/*' LIMIT 10",
    "What is being debugged?": "SHOW WORK UNITS FOR phase=debug",
    "What went from one agent to another?": "SHOW HANDOFFS",
    "What was the state of a project?": "STATE project p1 AT 2024-01-15",
    "What changed?": "DIFF STATE 2024-01-10 2024-01-12",
    "What is going on?": "WHAT IS project p1 DOING NOW",
    "Why is it blocked?": "WHY project p1 STATUS BLOCKED",
    "How many events of each kind?": "SELECT provider, kind, count(*) AS n FROM events GROUP BY 1, 2 ORDER BY 3 DESC",
    "Which sessions fail most?": "SELECT session_id, failure_count FROM sessions WHERE failure_count > 0 ORDER BY failure_count DESC, session_id LIMIT 10",
}
