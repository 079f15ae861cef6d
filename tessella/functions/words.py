"""Word lists, patterns and rules of the text classifiers."""

#: The lists below decide results and are kept as they are defined.

SOURCE_TAGS = [
    (["github.com"], "[GitHub]"), (["youtube.com", "youtu.be"], "[YouTube]"), (["medium.com", "dev.to", "hashnode"], "[Blog]"),
    (["arxiv.org"], "[arXiv]"), (["stackoverflow.com"], "[StackOverflow]"), (["docs.google.com", "drive.google.com"], "[GoogleDocs]"),
    (["notion.so", "notion.site"], "[Notion]"), (["figma.com"], "[Figma]"), (["twitter.com", "x.com"], "[Twitter]"), (["linkedin.com"], "[LinkedIn]"),
]

RELEVANCE_NEGATIVE = [
    "vlog", "music", "song", "singer", "musician", "movie", "film", "trailer", "funny", "meme", "prank", "cute", "pet", "animal", "cooking", "recipe", "food",
    "makeup", "beauty", "fashion", "shopping", "haul", "unboxing", "review", "family", "kids", "baby", "child", "home decor", "interior", "roof", "canopy",
    "fitness", "workout", "gym", "yoga", "dance", "choreography", "entertainment",
]
RELEVANCE_POSITIVE = [
    "software", "backend", "frontend", "devops", "api", "algorithm", "code", "programming", "developer", "database", "microservices", "docker", "kubernetes",
    "cloud computing", "web development", "deploy", "infrastructure", "coding interview", "system design", "distributed systems", "scalability",
    "performance optimization", "load balancing", "caching strategies", "cloud architecture", "software architecture", "multithreading", "concurrency",
    "memory management", "data structures", "algorithm analysis", "network bottleneck", "networking", "tcp", "http", "protocol", "server", "latency",
    "throughput", "bandwidth", "firewall", "load balancer", "reverse proxy", "cdn",
]
RELEVANCE_WEAK = ["system", "design", "architecture", "learning", "tutorial", "course", "engineering"]

JOB_REQUIRED = [
    "backend", "software engineer", "node.js", "javascript", "typescript", "devops", "fullstack", "full-stack", "python", "cloud", "infrastructure",
    "swe", "intern", "developer", "programming", "api", "database", "kubernetes", "docker", "microservices", "distributed systems",
]
JOB_EXCLUDED = [
    "store manager", "data entry", "paralegal", "sales agent", "no experience required", "military", "national guard", "manufacturing", "real estate",
    "insurance agent", "retail", "appointment setter", "document review", "outside sales", "operations roles", "membership offers", "assistant store",
    "financial accountant", "account manager", "credit card", "business strategy", "oracle services", "workday", "cyber", "project scheduling",
    "project assistant", "data analyst", "analytics and bi", "data warehouse", "msp service delivery", "director of operations",
]

MEME_SIGNALS = ["#short", "#shorts", "be like", "vs junior", "intern on first day", "meme", "funny", "prank", "cute", "pet", "animal"]

QUALITY_POSITIVE = [
    "open source", "release", "launch", "announce", "introducing", "breaking", "update", "security", "patch", "cve", "performance", "benchmark",
    "optimization", "scalability", "architecture", "distributed", "microservices", "kubernetes", "rust", "golang", "typescript", "wasm",
]
QUALITY_NEGATIVE = ["clickbait", "you won't believe", "shocking", "exposed", "scam", "fake", "spam", "ad", "sponsored", "gift card", "free money", "crypto giveaway"]

ON_TOPIC = [
    "học", "code", "lập trình", "programming", "algorithm", "thuật toán", "javascript", "python", "node", "react", "database", "sql", "git", "debug",
    "error", "bug", "deploy", "cloud", "api", "rest", "machine learning", "ai", "data structure", "design pattern", "flashcard", "quiz", "ôn tập", "bài tập", "dự án",
]
OFF_TOPIC = "chính trị|bầu cử|đảng phải|đảng tả|cờ bạc|cá độ|cược|khiêu dâm|porn|xxx|bạo lực|giết người|đánh nhau|hành hung|ma túy|cần sa|heroin|cocaine|lừa đảo|scam|fraud|tôn giáo|đạo giáo|phật giáo|thiên chúa|hồi giáo|sức khỏe|bệnh tật|y học|chữa bệnh"
GREETING = "^(hi|hello|hey|chào|xin chào|ok|cảm ơn|thanks)"

LOG_RULES = [
    ("oom|out of memory", "oom", "critical"), ("fatal|uncaughtexception", "fatal", "critical"), ("econnrefused|econnreset", "connection", "high"),
    ("timeout|etimedout", "timeout", "medium"), ("rate limit|429", "rate_limit", "medium"), ("401|403|unauthorized|forbidden", "auth", "high"),
]

AUDIT_RULES = [
    ("eval\\s*\\(", "high"), ("child_process|exec\\s*\\(|execsync\\s*\\(", "high"), ("innerhtml\\s*=", "medium"), ("document\\.write\\s*\\(", "medium"),
    ("password\\s*=\\s*[\"'][^\"']+[\"']", "high"), ("api[_-]?key\\s*=\\s*[\"'][^\"']+[\"']", "high"), ("select\\s+.*\\s+from\\s+.*\\+", "high"), ("http://", "low"),
]

ROUTE_NAMES = ["log", "error", "config", "docker"]
ROUTE_TEXTS = ["error", "exception", "stack trace", "pm2"]

JOB_TAGS = [
    "javascript", "typescript", "python", "java", "go", "golang", "rust", "react", "vue", "angular", "node", "nodejs", "express", "nextjs", "aws", "gcp",
    "azure", "docker", "kubernetes", "terraform", "sql", "postgresql", "mongodb", "redis", "elasticsearch", "machine learning", "ml", "ai", "deep learning",
    "backend", "frontend", "fullstack", "devops", "sre", "api", "microservices", "distributed systems", "security", "cybersecurity", "pentesting", "data",
    "analytics", "big data", "spark", "hadoop", "mobile", "ios", "android", "react native", "flutter", "blockchain", "web3", "solidity", "figma", "design",
    "ux", "ui", "agile", "scrum", "jira", "ci/cd", "jenkins", "github actions", "linux", "unix", "bash",
]

POSITIVE = [
    "thanks", "cảm ơn", "hay", "tuyệt", "được", "ok", "good", "great", "awesome", "cool", "nice", "perfect", "🎉", "😂", "👍", "❤️", "🔥", "giỏi", "xịn", "chất", "vl",
    "đỉnh", "pro", "master", "slay", "hiểu rồi", "rõ ràng", "clear", "đúng", "correct", "yes", "yep",
]
NEGATIVE = [
    "không hiểu", "confused", "lỗi", "error", "bug", "sai", "wrong", "stuck", "kẹt", "khó", "hard", "difficult", "frustrated", "😤", "💩", "🤬", "😡", "ugh", "wtf",
    "fuck", "shit", "damn", "chán", "boring", "xàm", "useless", "vô dụng", "tệ", "bad", "không được", "fail", "failed", "timeout", "crash", "oom",
]
STRESSED = [
    "deadline", "gấp", "urgent", "asap", "help", "cứu", " SOS", "không kịp", "overwhelm", "quá tải", "nhiều quá", "mệt", "exhausted", "burnout", "kiệt sức", "2am",
    "3am", "đêm", "trễ", "late", "miss", "thi", "exam", "test", "interview",
]
CELEBRATING = [
    "giải được", "solved", "ac", "accepted", "passed", "đậu", "xong", "done", "hoàn thành", "complete", "ship", "deploy", "merge", "promoted", "tuyển", "offer", "🎉", "🥳", "🏆",
]

INTENTS = [
    ("WEATHER", "thời tiết|nhiệt độ|mưa|nắng|gió|cloud|weather|temperature"), ("CODE", "code|viết|chạy|debug|fix|bug|function|class|script|program"),
    ("DEBATE", "debate|tranh luận|so sánh|phản bác|argue"), ("QUIZ", "quiz|trắc nghiệm|kiểm tra|test|question"), ("LEARN", "học|learn|giảng|explain|hiểu|understand|tutorial"),
    ("PLAN", "plan|kế hoạch|roadmap|lộ trình|schedule"), ("VISION", "vision|ảnh|image|nhìn|thấy|photo|picture"), ("VOICE", "voice|audio|nghe|nói|transcribe|speech"),
    ("ANIMATE", "animate|video|animation|manim|render"), ("ANALYZE", "analyze|phân tích|review|check|inspect"), ("AUDIT", "audit|bảo mật|security|vulnerability|scan"),
    ("PROFILE", "profile|hồ sơ|thông tin|stats|thống kê"), ("MEMORY", "memory|nhớ|ghi nhớ|recall|history"), ("SEARCH", "search|tìm|find|look up|google"),
    ("HELP", "help|trợ giúp|hướng dẫn|command|lệnh"),
]

CODE_WORDS = "function|class|def|import|const|var|let|return|if|else|for|while|async|await|try|catch|throw|new|this|super|extends|implements|interface|type|enum|struct|fn|pub|mod|use|crate"
MODEL_POWERFUL = "code|algorithm|debug|implement|function|class|error|bug|refactor|test"
MODEL_FAST = "^(what|who|when|where|how|is|are|do|does|can|could|why|which)\\b"
MODEL_DEEP = "explain|analyze|compare|design|architecture|optimize|trade.?off|review|evaluate"

CITATION = "source|according to|dựa trên|theo nguồn"
UNCERTAIN = "không tìm thấy|không có dữ liệu|không đủ|could not find|not found"
HAS_SOURCE = "source|according to|based on|from|reference"
REFUSAL = "i don't know|i cannot|i'm unable|i don't have information"

REPUTATION = [
    ("github.com", 0.95), ("arxiv.org", 0.95), ("news.ycombinator.com", 0.90), ("stackoverflow.com", 0.85),
    ("leetcode.com", 0.90), ("simplifyjobs.com", 0.85), ("remoteok.com", 0.80), ("weworkremotely.com", 0.80), ("greenhouse.io", 0.80), ("lever.co", 0.80), ("ashbyhq.com", 0.80),
    ("reddit.com", 0.60), ("twitter.com", 0.50), ("x.com", 0.50), ("linkedin.com", 0.65), ("youtube.com", 0.55), ("indeed.com", 0.45), ("glassdoor.com", 0.45), ("ziprecruiter.com", 0.40),
]

ERROR_CLASSES = [
    (["memory leak", "asan", "heap-use-after-free", "definitely lost"], "MEMORY_LEAK"), (["segfault", "segmentation", "access violation", "null pointer"], "NULL_POINTER"),
    (["timeout", "infinite", "timelimit", "tle"], "INFINITE_LOOP"), (["compile", "syntax", "undefined reference"], "COMPILE_ERROR"), (["wrong", "incorrect", "expected", "mismatch"], "LOGIC_ERROR"),
    (["stack overflow", "recursion", "deep recursion"], "STACK_OVERFLOW"),
]

REPO_CLASSES = [
    ("machine learning|neural|deep learning|llm|transformer|ai model", "AI"), ("docker|kubernetes|deploy|ci/cd|infrastructure|terraform|devops", "DevOps"),
    ("algorithm|data structure|complexity|sorting|graph|tree|dynamic programming", "Algorithms"), ("calculus|linear algebra|statistics|probability|theorem|proof|equation", "Math"),
]
CODE_LANGUAGES = [
    (["#include", "std::", "cout", "cin"], "cpp"), (["public class", "System.out", "import java."], "java"), (["def ", "import "], "python"),
    (["function ", "const ", "let ", "=>"], "javascript"), (["#!/bin/bash", "echo ", "grep "], "bash"),
]
DOMAIN_RULES = [
    ("backend", ["backend", "server", "api", "rest", "graphql", "microservice", "endpoint", "middleware", "express", "fastapi", "django", "spring", "node", "nginx", "apache"]),
    ("devops", ["devops", "docker", "kubernetes", "k8s", "deploy", "ci/cd", "terraform", "ansible", "jenkins", "github actions", "monitoring", "prometheus", "grafana"]),
    ("database", ["database", "sql", "nosql", "postgresql", "mysql", "mongodb", "redis", "elasticsearch", "sharding", "replication", "indexing", "query"]),
    ("distributed-systems", ["distributed", "consensus", "raft", "paxos", "cap theorem", "eventual consistency", "message queue", "kafka", "rabbitmq", "pub/sub", "service mesh"]),
    ("algorithms", ["algorithm", "data structure", "sorting", "searching", "graph", "tree", "dynamic programming", "hash", "heap", "stack", "queue"]),
    ("networking", ["networking", "tcp", "udp", "http", "dns", "ssl", "tls", "websocket", "load balancer", "cdn", "firewall", "latency"]),
    ("ai-ml", ["machine learning", "deep learning", "neural network", "transformer", "llm", "gpt", "bert", "cnn", "rnn", "embedding", "fine-tuning", "rag", "prompt engineering"]),
    ("security", ["security", "authentication", "authorization", "oauth", "jwt", "encryption", "vulnerability", "penetration", "firewall", "xss", "csrf", "injection"]),
    ("programming", ["python", "javascript", "typescript", "java", "c++", "c#", "go", "rust", "ruby", "php", "swift", "kotlin", "compiler", "interpreter"]),
    ("system-design", ["system design", "architecture", "scalability", "performance", "caching", "load balancing", "microservices", "monolith", "event-driven"]),
    ("cloud", ["cloud", "aws", "gcp", "azure", "serverless", "lambda", "ec2", "s3", "cloudformation", "iaas", "paas", "saas"]),
    ("math", ["math", "calculus", "linear algebra", "statistics", "probability", "optimization", "differential", "integral", "matrix"]),
    ("physics", ["physics", "mechanics", "thermodynamics", "electromagnetism", "quantum", "relativity", "optics", "energy", "force", "momentum"]),
    ("social-science", ["psychology", "sociology", "philosophy", "economics", "politics", "history", "anthropology", "cognitive", "behavioral", "emotion", "motivation"]),
]
CATEGORY_DOMAINS = [
    ("Backend", "backend"), ("DevOps", "devops"), ("Database", "database"), ("AI", "ai-ml"), ("Math", "math"), ("Algorithms", "algorithms"), ("Security", "security"),
    ("Networking", "networking"), ("System Design", "system-design"), ("Cloud", "cloud"), ("Physics", "physics"), ("Social", "social-science"),
]

QUERY_DOMAINS = [
    ("backend", [
        "backend", "server", "api", "database", "sql", "nosql", "rest", "graphql", "microservice", "docker", "kubernetes", "devops", "ci/cd", "deploy", "cloud", "aws", "gcp",
        "azure", "linux", "nginx", "apache", "redis", "kafka", "rabbitmq", "grpc", "websocket", "oauth", "jwt", "cdn", "load balancer", "scaling", "sharding", "replication",
        "caching", "indexing", "query optimization", "distributed system", "consensus", "raft", "paxos", "cap theorem", "eventual consistency", "message queue", "pub/sub",
        "service mesh", "observability", "monitoring", "logging", "tracing",
    ]),
    ("frontend", [
        "frontend", "react", "vue", "angular", "javascript", "typescript", "css", "html", "webpack", "vite", "nextjs", "nuxt", "spa", "pwa", "responsive", "accessibility",
        "seo", "dom", "virtual dom", "state management", "redux", "zustand", "tailwind", "sass", "less",
    ]),
    ("algorithms", [
        "algorithm", "data structure", "sorting", "searching", "graph", "tree", "dynamic programming", "greedy", "backtracking", "big o", "complexity", "hash", "heap", "stack",
        "queue", "linked list", "binary search", "bfs", "dfs", "dijkstra", "shortest path", "minimum spanning tree", "topological sort",
    ]),
    ("ml_ai", [
        "machine learning", "deep learning", "neural network", "transformer", "llm", "gpt", "bert", "cnn", "rnn", "lstm", "gan", "reinforcement learning", "supervised",
        "unsupervised", "classification", "regression", "clustering", "embedding", "fine-tuning", "prompt engineering", "rag", "vector database", "attention mechanism",
        "backpropagation", "gradient descent", "overfitting", "underfitting", "cross validation",
    ]),
    ("physics", [
        "physics", "mechanics", "thermodynamics", "electromagnetism", "quantum", "relativity", "optics", "fluid dynamics", "statistical mechanics", "particle physics", "nuclear",
        "astrophysics", "cosmology", "string theory", "wave", "energy", "force", "momentum", "entropy", "schrodinger", "heisenberg", "maxwell", "newton", "einstein",
    ]),
    ("social", [
        "psychology", "sociology", "philosophy", "economics", "politics", "history", "anthropology", "linguistics", "cognitive", "behavioral", "social", "culture", "society",
        "ethics", "morality", "consciousness", "perception", "memory", "learning", "motivation", "emotion", "personality", "mental health", "therapy", "counseling",
    ]),
]
QUERY_CATEGORIES = [("backend", "Backend"), ("algorithms", "Algorithms"), ("ml_ai", "AI")]

PERSONA_THERAPIST = [
    r"\bmệt\b|\bstress\b|\blo lắng\b|\bbuồn\b|\bchán\b|\bnản\b|\báp lực\b",
    r"\bdeadline\b|\bsập\b|\bcrash\b|\bburnout\b|\bkiệt sức\b|\bcô đơn\b",
    r"\btâm sự\b|\bkể nghe\b|\btrò chuyện\b|\bgiải tỏa\b|\bcảm xúc\b",
    r"\btình cảm\b|\bhạnh phúc\b|\bvui\b|\bđau\b|\bmất ngủ\b|\bngủ không ngon\b",
    r"\bchào\b|\bhi\b|\bhello\b|\bhey\b|\bcảm ơn\b|\bthank\b|\bxin lỗi\b",
    r"\bbạn là ai\b|\btên bạn\b|\bbạn tên gì\b|\bai tạo ra bạn\b|\bbạn biết gì\b",
    r"\bbạn khỏe không\b|\bnhư thế nào\b|\bthế nào\b|\bgì vậy\b|\bsao\b",
    r"lắng nghe|tâm sự|kể chuyện|sự cố|chán ghét",
    r"\bmệt\b|\bmỏi\b|\bmệt mỏi\b|\bchán ghét\b|\bbực bội\b",
]
PERSONA_TECHNICAL = [
    r"\bcode\b|\bviết\b|\bchạy\b|\bcompile\b|\bdebug\b|\bfunction\b|\bclass\b|\bmethod\b",
    r"\bapi\b|\blibrary\b|\bframework\b|\bscript\b|\bmodule\b|\bpackage\b",
    r"\bdocker\b|\bkubernetes\b|\bk8s\b|\bdeploy\b|\bci\/cd\b|\bpipeline\b|\bserver\b",
    r"\bdatabase\b|\bsql\b|\bnosql\b|\bredis\b|\bmongodb\b|\bpostgres\b",
    r"\barchitecture\b|\bmicroservices\b|\bmonolith\b|\bscalab\b|\bperformance\b|\bcache\b",
    r"\balgorithm\b|\bthuật toán\b|\bsort\b|\bsearch\b|\btree\b|\bgraph\b|\bhash\b",
    r"\bhttp\b|\btcp\b|\budp\b|\bdns\b|\bssl\b|\btls\b|\bwebsocket\b|\brest\b",
    r"\bgit\b|\bgithub\b|\bvscode\b|\blinux\b|\bterminal\b|\bbash\b|\bnginx\b",
]

ENTITY_STOP = ["như thế nào", "là gì", "tại sao", "thế nào", "có thể", "những gì", "được không"]
ENTITY_NAMES = r"[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*"
ENTITY_TERMS = r"\b[a-z]+(?:[A-Z][a-z]+)+\b|\b[a-z]+(?:_[a-z]+)+\b|\b[A-Z]{2,}\b"

TOPICS = r"(?i)(?:^|\n)#+\s+(.+)|(?:topic|subject|about|về)\s*:\s*(.+)"
#: The same for Java, where (?i) knows ASCII only; in DuckDB it also takes a long s for an s and the capital of ề.
TOPICS_JAVA = TOPICS.replace("subject", "[s\u017f]ubject").replace("\u1ec1", "[\u1ec1\u1ec0]")
FUNCTIONS = r"(?:void|int|char|bool|float|double|long|string|auto|public|private|protected|static|def|function|class)\s+\w+\s*\([^)]*\)\s*\{[^}]*\}"

BRANCHES = {
    "javascript": r"\b(if|else\s+if|for|while|do|switch|case|catch|&&|\|\||\?)\b",
    "python": r"\b(if|elif|else|for|while|except|and|or|with|assert)\b",
    "java": r"\b(if|else\s+if|for|while|do|switch|case|catch|&&|\|\||\?)\b",
    "c": r"\b(if|else\s+if|for|while|do|switch|case|&&|\|\||\?)\b",
    "cpp": r"\b(if|else\s+if|for|while|do|switch|case|catch|&&|\|\||\?|try|throw)\b",
    "csharp": r"\b(if|else\s+if|for|while|do|switch|case|catch|&&|\|\||\?|try|throw)\b",
    "go": r"\b(if|else|for|switch|case|select|&&|\|\|)\b",
    "rust": r"\b(if|else|for|while|loop|match|&&|\|\||\?)\b",
}
SEVERITY_COSTS = [("critical", 15), ("error", 10), ("warning", 5), ("info", 2)]
CATCH_EMPTY = r"catch\s*\([^)]*\)\s*\{\s*\}"
CONSOLE = r"console\.(log|debug|info)\s*\("
CREDENTIALS = r"(?i)(password|secret|api_key|token|apikey)\s*[:=]\s*['\"][^'\"]{8,}['\"]"
SQL_BUILT = r"(query|execute|exec)\s*\(\s*['\"`].*\$\{|(query|execute|exec)\s*\(\s*['\"`]\s*\+"
EVAL, VAR = r"\beval\s*\(", r"\bvar\s+"
ASYNC, TRY = r"async|await|Promise|\.then\(", r"try\s*\{"
TODO = r"(?i)TODO|FIXME|HACK|XXX"
MAGIC = r"[^a-zA-Z_](\d{2,})"
