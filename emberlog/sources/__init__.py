from emberlog.sources.arrays import read_json_array
from emberlog.sources.logs import lines_from_events, read_log_text, read_records_json
from emberlog.sources.sinks import write_incident_array, write_incident_lines, write_json_array, write_json_lines

__all__ = ["lines_from_events", "read_json_array", "read_log_text", "read_records_json", "write_incident_array", "write_incident_lines", "write_json_array", "write_json_lines"]
