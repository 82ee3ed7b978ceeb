"""Rule lists and word lists that results depend on. Stated as plain text."""

# Rules selected for automatic fixing.
SAFE_RULES = """
java:S1118 java:S1481 java:S125 java:S1068 java:S1144 java:S1134 java:S1135 java:S1125 java:S1121 java:S1128
java:S1488 java:S1854 java:S2094 java:S2097 java:S2130 java:S2209 java:S2786 java:S2975 java:S3457 java:S3862
java:S4275 java:S4973
common-java:InsufficientCommentDensity common-java:InsufficientLineCoverage common-java:DuplicatedBlocks
""".split()

# Rules with a rule handler.
HANDLER_RULES = """
java:S1068 java:S1125 java:S3776 java:S125 java:S1118 java:S1488 java:S116 java:S100 java:S117 java:S1186
java:S6437 java:S4973 java:S1192 java:S1643 java:S1155 java:S108 java:S109 java:S106 java:S1144 java:S1172
java:S112 java:S1134 java:S1135 java:S2068 java:S3649 java:S2076 java:S2864 java:S1132 java:S1126
""".split()

# Rules with a whole-text fixer.
TEXT_FIXER_RULES = "java:S1118 java:S1481 java:S125 java:S2190 java:S6437 java:S6703".split()

# Statuses of an open finding.
OPEN_STATUSES = ["OPEN", "CONFIRMED", "REOPENED"]

# Words that make a text look like a credential.
CREDENTIAL_WORDS = ["pass", "pwd", "secret", "key", "token", "credential"]

# Words that let the assignment rewrite look at a line at all.
ASSIGNMENT_WORDS = ["pass", "pwd", "secret", "key"]

# Simple names every file can use, all labelled java.lang.
COMMON_TYPES = """
Object String Number Integer Long Double Float Boolean Character Byte Short Void Exception RuntimeException
Iterable Collection List ArrayList Set HashSet Map HashMap Optional
""".split()

PRIMITIVE_TYPES = "boolean byte char short int long float double void".split()

# Default number of fixes per batch.
MAX_FIXES = 10

NO_FIXER_REASON = "No fixer available for this issue"
