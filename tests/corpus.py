"""A small corpus and its queries, for tests against plain models."""

# A corpus of our own with the shape the scenarios need: pooling and security
# texts, a short tip and a long guide on one subject, and a keyword-stuffed page.
CORPUS = [
    (1, "Troubleshooting pool exhaustion", "When every connection in the pool is busy, new requests wait. "
        "Check for sessions that stay idle in a transaction, then raise the pool size or repair the leak. Problems "
        "often vanish after a restart of the client.", "troubleshooting"),
    (2, "Getting started with connection pooling", "A database server forks one process per connection. "
        "Pooling keeps a few of them open and shares them.", "tutorial"),
    (3, "Database fundamentals", "Tables, rows and keys are the base of every relational database. "
        "Start with a primary key and proper indexing.", "tutorial"),
    (4, "Pooling modes compared", "Session pooling and transaction pooling suit different clients of a database.", "tutorial"),
    (5, "Authentication methods", "Choose certificate authentication or a strong password for each role that reaches the database. "
        "Rotate secrets every quarter.", "security"),
    (6, "Securing stored data", "Keep the disk encrypted and run the server securely behind a firewall. "
        "Security reviews of the database should be routine.", "security"),
    (7, "Protecting backups", "Encryption protects copies of your database when a backup medium is lost. "
        "Access to keys must be restricted.", "security"),
    (8, "Quick tip", "Run EXPLAIN ANALYZE before you tune a slow PostgreSQL query.", "tip"),
    (9, "Configuration values", "Set max_connections = 100 and note error PG-1234 in release 15.3 of the server.", "reference"),
    (10, "Complete guide to query plans", "EXPLAIN shows the plan and EXPLAIN ANALYZE runs it. Reading EXPLAIN output takes practice: "
        "EXPLAIN prints cost, rows and width for every node, while ANALYZE adds real time and loops. "
        "In PostgreSQL you can ask EXPLAIN for buffers as well. Compare the EXPLAIN estimate with the ANALYZE "
        "result, look at the widest gap first, refresh statistics, and repeat until the numbers of the whole "
        "tree agree with what the storage and the memory of your machine can be expected to deliver.", "reference"),
    (11, "Best database database tips", "Database database database! Our database page has database news, database jobs, "
        "database deals and database facts. Database lovers call this database the database of all. Database now!", "spam"),
    (12, "Index strategies", "Good indexing of a database follows its queries. Partial and covering indexes cut reads; "
        "indexing too much slows every write.", "performance"),
    (13, "Query tuning", "Rewrite a slow query, add statistics, and watch how the planner of PostgreSQL reacts before you buy hardware.", "performance"),
    (14, "Row stores and column stores", "A row store suits short transactions, a column store suits reports over the same database.", "comparison"),
    (15, "Layers of a service", "Caches, queues and a database form the usual layers. Each of them can fail on its own.", "architecture"),
]

# Queries whose hits the given baseline counts.
QUERIES = [
    (1, "db connection pooling", "keyword"),
    (2, "datab connection pooling", "keyword"),
    (3, "database connection pooling", "keyword"),
    (4, "database authentication", "idf"),
    (5, "explain analyze postgresql", "length"),
    (6, "database indexing", "saturation"),
    (7, "fix my connection pool problems", "agent"),
    (8, "secure my postgres database", "agent"),
    (9, "database", "saturation"),
    (10, "PG-1234", "keyword"),
    (11, "15.3", "keyword"),
    (12, "c++", "keyword"),
    (13, "pool pool a", "keyword"),
    (14, "   ", "keyword"),
]
