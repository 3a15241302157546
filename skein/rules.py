"""Fixed rule tables, as plain values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values: (type of an unconnected node, type of its partner, relation) of fallback edges, directed.
ORPHAN_EDGES = [
    ("task", "question", "leads-to"), ("task", "error", "resolves"), ("task", "decision", "implements"),
    ("task", "file", "references"), ("task", "skill", "uses"), ("task", "concept", "references"),
    ("task", "task", "depends-on"), ("error", "file", "created-by"), ("error", "task", "blocks"),
    ("decision", "concept", "documents"), ("decision", "skill", "uses"), ("decision", "task", "implements"),
    ("question", "concept", "references"), ("question", "decision", "leads-to"), ("file", "decision", "implements"),
    ("file", "skill", "uses"), ("concept", "task", "references"), ("concept", "question", "references"),
    ("concept", "skill", "uses"), ("skill", "concept", "uses"),
]

# Relations inferred between nodes that share words, tried in both directions.
INFERRED = [
    ("task", "question", "leads-to"), ("task", "error", "resolves"), ("task", "decision", "implements"),
    ("task", "file", "references"), ("task", "skill", "uses"), ("error", "file", "created-by"), ("error", "task", "blocks"),
    ("decision", "concept", "documents"), ("decision", "skill", "uses"), ("question", "concept", "references"),
    ("question", "decision", "leads-to"), ("skill", "concept", "uses"), ("concept", "skill", "uses"),
    ("file", "decision", "implements"), ("file", "skill", "uses"),
]

# What relates-to becomes between two types.
UPGRADES = [
    ("task", "decision", "implements"), ("decision", "task", "implements"), ("task", "error", "resolves"),
    ("error", "task", "blocks"), ("task", "skill", "uses"), ("skill", "task", "uses"), ("task", "file", "references"),
    ("file", "task", "references"), ("task", "question", "leads-to"), ("question", "task", "leads-to"),
    ("task", "concept", "references"), ("concept", "task", "references"), ("decision", "concept", "documents"),
    ("concept", "decision", "documents"), ("decision", "file", "references"), ("file", "decision", "implements"),
    ("decision", "error", "resolves"), ("error", "decision", "blocks"), ("decision", "skill", "uses"),
    ("skill", "decision", "uses"), ("file", "skill", "uses"), ("skill", "file", "uses"), ("file", "question", "references"),
    ("question", "file", "references"), ("error", "file", "created-by"), ("file", "error", "created-by"),
    ("question", "concept", "references"), ("concept", "question", "references"), ("question", "decision", "leads-to"),
    ("decision", "question", "leads-to"), ("skill", "concept", "uses"), ("concept", "skill", "uses"),
]

# Pairs of different types whose likeness makes an edge, unordered.
CROSS_PAIRS = [("task", "question"), ("task", "decision"), ("concept", "skill"), ("error", "task")]

# Patterns masked before anything reads a text.
MASKS = [
    r"(?i)(password|passwd|secret|token|api[_\-]?key)\s*[=:]\s*\S+",
    r"(?i)bearer\s+[A-Za-z0-9\-._~+/]+=*",
    r"AKIA[0-9A-Z]{16}",
    r"(?i)postgres(?:ql)?://[^\s\"']+",
    r"(?i)mysql://[^\s\"']+",
    r"(?i)mongodb\+srv://[^\s\"']+",
]

# File endings and language aliases.
LANGUAGES = {
    "py": "python", "js": "javascript", "ts": "typescript", "jsx": "javascriptreact", "tsx": "typescriptreact", "go": "go",
    "rs": "rust", "java": "java", "rb": "ruby", "sh": "bash", "bash": "bash", "zsh": "bash", "fish": "fish", "tf": "hcl",
    "yaml": "yaml", "yml": "yaml", "json": "json", "toml": "toml", "sql": "sql", "md": "markdown", "html": "html",
    "css": "css", "c": "c", "cpp": "cpp", "cs": "csharp",
}

# Words that count for nothing when labels are compared; healing keeps "use" and "using".
STOP_HEAL = ["the", "a", "an", "is", "in", "on", "at", "to", "for", "of", "and", "or", "but", "with", "by", "this", "that",
             "it", "be", "are", "was", "were", "has", "have", "had", "not"]
STOP = [*STOP_HEAL, "use", "using"]

# What a label of type file looks like when it is one, when it is a task and when it is a concept.
FILE_KEEP = r"\.[a-zA-Z]{1,6}$|[/\\]|[(\[{]|::|__|^\."
FILE_TO_TASK = (
    r"(?i)→|^(commit|merge)\s+[a-f0-9]{4,}|^(CI|PR|MR|GH|run)\s*#?\s*\d+|^PR\s+(title|to|review|comment|description|body)"
    r"|^(job logs?|build logs?|test run|pipeline run)|^(attached file|PR file)|\s--[a-z-]|\bscript\b$|\bIssue\s*#"
    r"|\bGitHub\s+PR\b|\bPR\s+from\b|\bPR\s+for\b|\s+PR$|\bworkflow\s+file\b"
)
FILE_TO_CONCEPT = (
    r"(?i)\b(repository|repo)\b|^(branch protection|branch policy|ruleset)"
    r"|\b(settings|dashboard|panel|configuration page|admin)\b|^[A-Z][A-Z0-9_]{2,}$|\b(terminal|shell)\b"
    r"|\b(badge|account|site|backend|process)\b|^(macOS|windows|linux)\b|\bform\b"
)

# Words of speculation, and model names of versions that aren't known.
SPECULATION = (
    r"(?i)\b(might|could|maybe|perhaps|possibly|future version|upcoming|not yet|not released|hypothetically|we could"
    r"|planning to|would use|plan to use|when it releases|once it's out|when available)\b"
)
PHANTOM_MODEL = (
    r"(?i)\b(gpt-[5-9][\.\d]*(?![\w-])|gpt-[1-9]\d[\.\d]*|claude-[5-9][\.\d]*(?![\w-])|gemini-[3-9][\.\d]*(?![\w-]))\b"
)

# Conventional commit prefixes.
COMMIT_HINTS = {
    "feat": "decision — new feature", "fix": "error — bug fix", "refactor": "decision — refactor", "chore": "task",
    "docs": "concept — documentation", "test": "task — tests", "ci": "task — CI/CD", "perf": "skill — performance",
    "build": "decision — build change", "revert": "decision — revert", "wip": "task — work in progress",
}

# Node types of infrastructure resources; everything else is a concept.
TERRAFORM_TYPES = {
    "aws_lambda_function": "decision", "aws_ecs_service": "decision", "aws_ecs_task_definition": "decision", "aws_instance": "decision",
    "aws_dynamodb_table": "decision", "aws_s3_bucket": "decision", "aws_rds_cluster": "decision", "aws_elasticache_cluster": "decision",
    "aws_opensearchservice_domain": "decision", "aws_api_gateway_rest_api": "decision", "aws_api_gateway_v2_api": "decision",
    "aws_vpc": "decision", "aws_subnet": "concept", "aws_security_group": "concept", "aws_lb": "decision", "aws_iam_role": "concept",
    "aws_iam_policy": "concept", "variable": "concept", "locals": "concept", "output": "concept", "data": "concept",
}
CFN_TYPES = {
    "AWS::Lambda::Function": "decision", "AWS::DynamoDB::Table": "decision", "AWS::S3::Bucket": "decision",
    "AWS::ApiGateway::RestApi": "decision", "AWS::ApiGatewayV2::Api": "decision", "AWS::ECS::Service": "decision",
    "AWS::RDS::DBCluster": "decision", "AWS::ElastiCache::CacheCluster": "decision", "AWS::OpenSearchService::Domain": "decision",
    "AWS::IAM::Role": "concept", "AWS::IAM::Policy": "concept", "AWS::EC2::VPC": "decision", "AWS::EC2::SecurityGroup": "concept",
    "AWS::ElasticLoadBalancingV2::LoadBalancer": "decision",
}

# Patterns of what turns hold beside prose.
FENCE = r"(?s)```(\w*)\n(.*?)```"
PYTHON_TRACE = r"(?s)(?:Traceback \(most recent call last\):.*?)(\w+(?:\.\w+)*Error|\w+Exception|KeyboardInterrupt):\s*(.+)"
PYTHON_PLACE = r"File \"([^\"]+)\", line (\d+)"
SCRIPT_ERROR = r"(TypeError|ReferenceError|SyntaxError|Error):\s*(.+?)(?:\n|$)"
SCRIPT_FRAME = r"at .+?\((.+?):(\d+):\d+\)"
HTTP_STATUS = r"\b(4\d\d|5\d\d)\b"
PYTEST = r"(?i)=+ ([\d,]+ passed|[\d,]+ failed|[\d,]+ error)"
JEST = r"(?i)Tests:\s+(\d+) passed.*?(\d+) failed"
NPM = r"(?i)npm ERR!"
ARN = r"arn:aws:[a-z0-9-]+:[a-z0-9-]*:\d+:[A-Za-z0-9:/_-]+"
EXIT_CODE = r"(?i)exited? (?:with )?(?:code )?(\d+)"
FILE_REF = r"(?m)(?:^|[\s`\"'])((?:\.{1,2}/|/|[A-Za-z]:[/\\])[A-Za-z0-9._/\\-]+\.[A-Za-z]{1,6})(?::(\d+))?"
URL = r"https?://[^\s'\"<>)]+"
JSON_FENCE = r"(?s)```json\n(.*?)```"
JSON_INLINE = r"(?s)(?<!\w)(\{[^`]{50,}?\})"

# Orders and icons of reports.
TYPE_ORDER_FOCUS = ["question", "error", "decision", "task", "skill", "concept", "file"]
TYPE_ORDER_CLUSTER = ["decision", "error", "question", "task", "skill", "concept", "file"]
ICONS = {"question": "❓", "decision": "✅", "concept": "💡", "skill": "🔧", "file": "📄", "error": "🐛", "task": "📋"}
TERMINAL_BY_TYPE = {"task": "done", "error": "fixed"}
INITIAL_BY_TYPE = {"question": "active", "decision": "proposed", "task": "pending", "error": "active"}


def lookup(values: dict[str, str], key: Column, default: str | None = None) -> Column:
    """The value of a small fixed map, folded into the plan."""
    pairs = [F.lit(x) for kv in values.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), key), F.lit(default))


def relation_of(rules: list[tuple[str, str, str]], a: Column, b: Column) -> Column:
    """The relation of a rule table for two type columns; null where there is no rule. At most a few dozen literals."""
    return F.element_at(F.create_map(*[F.lit(x) for s, t, r in rules for x in (f"{s}>{t}", r)]), F.concat(a, F.lit(">"), b))


def rule_frame(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """A rule table as rows (from_type, to_type, relation); a fixed few dozen, fit to broadcast."""
    return spark.createDataFrame(rules, "from_type string, to_type string, relation string")
