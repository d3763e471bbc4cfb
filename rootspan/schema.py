"""Schemas of the tables that all jobs share. Times are UTC instants; ``properties`` values are text."""

NODES = "id string, label string, class string, region string, rack_id string, properties map<string,string>"
EDGES = "id string, source_id string, target_id string, edge_type string, properties map<string,string>"
MUTATIONS = "id string, node_id string, mutation_type string, source string, timestamp timestamp, properties map<string,string>"
SIGNALS = "id string, node_id string, signal_type string, value double, severity string, timestamp timestamp, properties map<string,string>"
CPTS = "class string, mutation string, signal string, p_present double, p_absent double"
PRIORS = "class string, p_failure double, half_life_min double"
LAYERS = "layer_no int, class_pos int, cpt_pos int, class string, p_failure double, half_life_min double, mutation string, signal string, p_present double, p_absent double"
RULES = "rule_no int, signal_type string, class string, source string, pattern string, min_confidence double, max_confidence double, action string, reason string"
NODE_STRUCT = "struct<id:string,label:string,class:string,region:string,rack_id:string,properties:map<string,string>>"
EDGE_STRUCT = "struct<id:string,source_id:string,target_id:string,edge_type:string,properties:map<string,string>>"
PAYLOAD = f"nodes array<{NODE_STRUCT}>, edges array<{EDGE_STRUCT}>"
#: Fixed values.
DEFAULT_P_FAILURE, DEFAULT_HALF_LIFE = 0.005, 60.0
EDGE_TYPES = ["containment", "dependency", "connection"]
