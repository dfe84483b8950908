"""Fixed vocabularies of the graph model.

Fixed values: results depend on each of them, so they are listed as they are.
"""

# Node types that count as valid.
NODE_TYPES = (
    "Actor", "Feature", "Requirement", "BusinessRule", "Condition", "Action", "Output", "State", "SystemComponent", "SoftwareSystem", "Application", "Component", "Subsystem", "Microservice",
    "DataObject", "Constraint", "Event", "NonFunctionalRequirement", "Attribute", "Country", "Currency", "Language", "Location", "Service", "UIElement", "BusinessProcess", "Module", "Workflow",
    "API", "Screen", "Page", "TestCase", "Role", "Message", "Validation", "SearchOption", "Calendar", "BookingOption", "Risk", "Assumption", "Definition",
)

# Relation types that count as valid.
RELATIONS = (
    "USES", "REQUIRED_FOR", "TRIGGERS", "SHOWS", "LEADS_TO", "CAUSES", "CONTRIBUTES_TO", "PART_OF", "CREATES", "UPDATES", "GENERATES", "TRACKS", "CONTAINS", "OWNS", "AUTHENTICATES", "VALIDATES",
    "MONITORS", "NOTIFIES", "DEPENDS_ON", "ASSOCIATED_WITH", "PROCESSES", "STORES", "RETRIEVES", "EXECUTES", "VERIFIED_BY", "VERIFIES", "REALIZES", "REALIZED_BY", "RELATED_TO", "RELATES_TO",
    "ACTOR_OF", "PRODUCES", "VIEWS", "PERFORMS", "REFERENCES", "SUPPORTS", "CONSTRAINS", "THREATENS", "DEFINES", "NEXT_IN_DOCUMENT", "NAVIGATES_TO",
)

# Other names of relation types.
RELATION_SYNONYMS = {
    "STARTS_WITH": "TRIGGERS", "STARTS": "TRIGGERS", "BEGINS_WITH": "TRIGGERS", "DEPENDS_UPON": "DEPENDS_ON", "REQUIRES": "REQUIRED_FOR", "INCLUDES": "CONTAINS", "HAS": "CONTAINS",
    "USES_DATA": "USES", "CALLS": "EXECUTES", "INVOKES": "EXECUTES", "OPENS": "NAVIGATES_TO", "GOES_TO": "NAVIGATES_TO", "DISPLAYS": "SHOWS", "MODIFIES": "UPDATES", "ALERTS": "NOTIFIES",
}

# Words that are no relation type.
BLOCKED_RELATIONS = ("", "NULL", "UNDEFINED", "NONE", "AND", "OR", "THE", "A", "AN")

# Relations that may hold both ways; that may not point at an actor; and who may authenticate.
SYMMETRIC_RELATIONS = ("ASSOCIATED_WITH", "RELATED_TO", "RELATES_TO", "SUPPORTS", "CONTRIBUTES_TO", "REFERENCES", "NEXT_IN_DOCUMENT")
ACTOR_TARGET_FORBIDDEN = ("CREATES", "GENERATES", "PRODUCES", "UPDATES")
AUTHENTICATES_SOURCES = ("Actor", "SystemComponent", "Service", "Module", "API")

# Which type wins when sources disagree (others 0).
TYPE_PRIORITY = {
    "Actor": 10, "DataObject": 9, "SystemComponent": 8, "Feature": 7, "Requirement": 6, "NonFunctionalRequirement": 5, "BusinessRule": 4, "Action": 3, "Condition": 3, "Output": 3,
    "State": 2, "Constraint": 2, "Event": 2, "Attribute": 1,
}

# Relations that make up a flow, and node types (lower case) that are no part of one.
FLOW_RELATIONS = ("TRIGGERS", "LEADS_TO", "CAUSES", "CREATES", "UPDATES", "GENERATES", "NOTIFIES", "EXECUTES", "PRODUCES", "PERFORMS", "AUTHENTICATES", "PROCESSES", "VALIDATES", "MONITORS")
FLOW_EXCLUDED_TYPES = ("testcase", "documentmetadata", "author", "pageartifact", "metadata", "versionhistory")

# Role of each node type.
NODE_ROLES = {
    "actor": ("Actor", "Role", "User", "Persona"),
    "workflow_step": ("Action", "WorkflowStep", "Step", "Process", "Task", "Operation", "Feature"),
    "workflow_state": ("State", "WorkflowState", "Status", "Outcome", "Event", "Output"),
    "input": ("Input", "DataObject", "Data", "Parameter", "Field"),
    "metadata": ("Attribute", "Property"),
    "business_rule": ("BusinessRule", "Rule", "Policy", "Constraint", "Condition"),
    "requirement": ("Requirement", "FunctionalRequirement", "NonFunctionalRequirement", "UserStory"),
    "module": ("SystemComponent", "Module", "System", "Service"),
    "ui_element": ("Screen", "Page", "View", "Form", "Button", "Component"),
    "artifact": ("TestCase", "DocumentMetadata", "Author", "PageArtifact", "Metadata", "VersionHistory"),
}

# Role of each relation type.
EDGE_ROLES = {
    "workflow_transition": (*FLOW_RELATIONS, "NAVIGATES_TO", "SHOWS"),
    "dependency": ("HAS_STEP", "HAS_FEATURE", "DEPENDS_ON", "REQUIRED_FOR", "USES", "SUPPORTS", "CONTAINS", "PART_OF", "RETRIEVES", "STORES"),
    "business_rule": ("CONSTRAINS", "DEFINES"),
    "attribute": ("TRACKS", "OWNS"),
    "semantic_relation": ("ASSOCIATED_WITH", "RELATED_TO", "RELATES_TO", "REFERENCES", "CONTRIBUTES_TO", "ACTOR_OF", "VERIFIED_BY", "VERIFIES", "REALIZES", "REALIZED_BY", "THREATENS", "VIEWS"),
    "metadata": ("NEXT_IN_DOCUMENT",),
}

# Words in a name that tell a role, tried in this order.
NAME_ROLES = (
    ("ui_element", ("screen", "page", "view", "panel", "dashboard", "portal")),
    ("input", ("email", "password", "otp", "pin", "input", "field", "form", "entry", "amount", "currency")),
    ("workflow_step", ("login", "logout", "register", "signup", "checkout", "payment", "submit", "click", "upload", "download", "search", "select", "add", "remove", "create", "delete", "update", "verify", "authenticate", "authorize", "navigate")),
    ("workflow_state", ("success", "failure", "error", "rejected", "approved", "pending", "completed", "cancelled", "confirmed", "delivered", "shipped")),
    ("business_rule", ("rule", "policy", "constraint", "restriction", "limit", "condition", "requirement", "validation")),
)

# Families of item ids, by precedence: prefixes before digits, and prefixes before words.
ID_FAMILIES = (
    ("NFR", ("NFR", "NR", "NF"), ("NFR", "NR", "NF")),
    ("BR", ("BR", "BRD", "BU"), ("BR", "BRD")),
    ("TC", ("TC", "TEST", "TS"), ("TC", "TEST")),
    ("UC", ("UC", "USE"), ("UC",)),
    ("US", ("US", "UST"), ("US",)),
    ("US_PROSE", (), ()),
    ("FR", ("FR", "F"), ("FR",)),
    ("REQ", ("REQ", "RQ", "R"), ("REQ", "RQ")),
)

# Link type between two families; between equal families it is REFERENCES, otherwise RELATES_TO.
LINK_TYPES = {
    ("US", "TC"): "VERIFIED_BY", ("TC", "US"): "VERIFIES", ("FR", "TC"): "VERIFIED_BY", ("TC", "FR"): "VERIFIES", ("NFR", "TC"): "VERIFIED_BY", ("TC", "NFR"): "VERIFIES",
    ("UC", "TC"): "VERIFIED_BY", ("TC", "UC"): "VERIFIES", ("BR", "TC"): "VERIFIED_BY", ("TC", "BR"): "VERIFIES", ("FR", "BR"): "REALIZES", ("BR", "FR"): "REALIZED_BY",
    ("NFR", "BR"): "REALIZES", ("BR", "NFR"): "REALIZED_BY", ("US", "BR"): "REALIZES", ("BR", "US"): "REALIZED_BY", ("FR", "UC"): "REALIZES", ("UC", "FR"): "REALIZED_BY",
    ("US", "FR"): "RELATED_TO", ("FR", "US"): "RELATED_TO", ("US", "NFR"): "RELATED_TO", ("NFR", "US"): "RELATED_TO", ("REQ", "TC"): "VERIFIED_BY", ("TC", "REQ"): "VERIFIES",
    ("REQ", "BR"): "REALIZES", ("BR", "REQ"): "REALIZED_BY",
}

# Words in headings and id families that speak for a document type.
DOC_TYPE_WORDS = {
    "BRD": ("business requirement", "business objective", "business rule", "stakeholder", "scope", "business case", "problem statement"),
    "SRS": ("functional requirement", "non-functional requirement", "system requirement", "software requirement", "use case", "system architecture", "interface requirement"),
    "USER_STORY_DOC": ("user story", "user stories", "acceptance criteria", "as a user", "epic", "sprint backlog"),
    "TEST_PLAN": ("test case", "test plan", "test scenario", "expected result", "preconditions", "test steps"),
}
DOC_TYPE_FAMILIES = {"BRD": ("BR",), "SRS": ("FR", "NFR", "REQ", "UC"), "USER_STORY_DOC": ("US", "US_PROSE"), "TEST_PLAN": ("TC",)}

# Confidence scoring.
CONFIDENCE = {"base": 0.5, "twice": 0.15, "more": 0.25, "description": 0.10, "type_conflict": 0.20, "direction_conflict": 0.15, "linked": 0.15, "endpoints": 0.3, "low": 0.5}
