"""Tables of the memory store."""

TURNS = "date string, seq int, turn_id string, role string, content string, timestamp timestamp, agent_id string, message_id long"
FRAGMENTS = "fragment_id string, date string, frag_no int, start_turn_id string, end_turn_id string, task_desc string, result_desc string, tags array<string>, topic_name string, topic_slug string, agent_id string, turns_text string"
VECTORS = "fragment_id string, embedding array<float>"
DAILY = "date string, summary_md string"
TOPIC_ENTRIES = "topic_slug string, name string, date string, fragment_id string, summary string, status string, constraints array<string>, arrival long"
MESSAGES = "id long, session_id string, role string, content string, created_at string"
SESSIONS = "id string, agent_id string"
