"""Text functions as Column expressions: normal forms, token sets, answer classes, tags, redaction and reply parsing.

None of them shuffles or leaves the JVM. Nulls are treated as empty texts unless a function says otherwise.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: patterns, word lists and limits that results depend on ------------------------------------------

NO_ANSWER = r"(?i)not (explicitly )?(stated|mentioned|provided|specified|available|given)|no (answer|information|explicit)|does not (state|specify)|unknown|n/?a$"
NUMERIC = r"^-?\$?\s*\d[\d,]*(?:\.\d+)?\s*%?$"
LABEL = r"^[A-Za-z][\w \-/&'.]{0,48}$"
NOISY = r"(?i)[(/]|\b(usd|eur|kg|km|per|times|with|and)\b"
FAMILIES = (
    ("ml_fit", r"(?i)\b(?:random forest|decision tree|gradient boost\w*|xgboost|lightgbm|adaboost|svm|support vector|knn|k-nearest|neural net\w*|cnn|logistic regression|linear regression|polynomial regression|\w*regression|regressor|regression model|ridge|lasso|elastic ?net|naive bayes|k-means|kmeans|cluster\w*|pca|classifier|classification model|ensemble|bagging\w*|boosting\w*|stacking\w*|predict\w*|sarima|arima|train(?:ing)? (?:the |a )?(?:model|classifier)|cross[- ]validation|cross_val\w*|grid ?search|parameter tuning|tuning (?:the )?(?:hyper)?parameters?|hyperparameter|model training|fitting the model|fit the model|epoch|learning rate|feature importance|feature selection|confusion matrix|f1[- ]score|auc[- ]?roc|roc[- ]auc|accuracy(?: score| of)?|precision|recall|r2\b|r[- ]?squared|rmse|mae\b|mean (?:absolute|squared) error|residual\w*|baseline model|test set|overfitting|underfitting|whiten\w*|label encoding)\b"),
    ("stat_test", r"(?i)\bp-?value\b|significan\w*|chi[- ]?square|t[- ]test|anova|wilcoxon|mann[- ]whitney|kruskal|pearson|spearman|kendall|correlat\w*|regression coefficient|hypothesis test|normality|shapiro|kolmogorov|confidence interval|statistical (?:test|significance)|statistical propert\w+|white noise|stationar\w+|skew\w*|kurtos\w*|distribution\w* shape|dispers\w+|p\s*[-=]\s*value"),
    ("join", r"(?i)\bjoin(?:ed|ing|s)?\b|\bmerge[ds]?\b|\bcombine[sd]? (?:with|into)\b|\b(?:inner|left|right|outer|full)[- ]join\b"),
    ("lookup", r"(?i)\blook ?up\b|\bvalue of\b[^?.]{0,60}\b(?:where|for|at|when)\b|\bcorresponding (?:value|entry|row|record)\b|\bretrieve\b|\bfind the (?:entry|record|row)\b|\bfor the (?:row|record) where\b"),
    ("groupby", r"(?i)\bper\b|\bby (?:country|region|category|genre|team|company|author|artist|state|year|month|day|group|type|class|status|species|gender|brand|department|product|channel)\b|breakdown|\beach \w+|\bgrouped?\b|for every|\bby each\b"),
    ("count", r"(?i)\bhow many\b|\bnumber of\b|\bcount\b|\bhow often\b|\bhow much\b|\btotal (?:number|count)\b|\bhow many times\b"),
    ("argmax", r"(?i)\bmost common\b|\bmost frequent\b|\btop \d+\b|\bwhich (?:one|country|region|category|genre|team|company|author|artist|state|gender|brand|type|class|status|species|department|product|channel)\b|\bname the\b|\blist the\b|\bidentify\b"),
    ("filter", r"(?i)\bonly\b|\bwhere\b|\bwith\b|\bthat (?:is|are|was|were)\b|\bconsidering\b|\bexcluding\b|\bexcept\b|\bamong\b|\bfilt\w*|\bsatisf\w+|\bgreater than\b|\bless than\b|\babove\b|\bbelow\b|\bbetween\b|\bat least\b|\bif\b"),
    ("string", r"(?i)\bpercentage\b|\bfraction\b|\bproportion\b|\bshare\b|\bratio\b|\brate\b|\bpercent\b|\bcontains\b|\bstarts? with\b|\bends? with\b|\bmatches\b|\bregex\b|\bpattern\b|\bword\b|\bcharacter\b|\blength of\b"),
    ("agg", r"(?i)\bmean\b|\bmedian\b|\bsum\b|\btotal\b|\baverage\b|\bstd\b|\bstandard deviation\b|\bvariance\b|\bmax\w*|\bmin\w*|\blargest\b|\bsmallest\b|\bhighest\b|\blowest\b|\bfastest\b|\bslowest\b|\bweighted\b|\bpercentile\b|\bquantile\b|\bagg\w*|\bsumma\w*|\btop\b|\bmost\b|\bfrequency\b|\bmode\b"),
)
NONDETERMINISM = (
    ("model fit", r"(?i)\bfit\b|\bfitted\b|\bfitting\b|\btrain(?:ed|ing)? (?:a|the|an)? ?model|\bclassifier\b|\bregress\w+|\brandom forest\b|\bgradient boost\w*|\bknn\b|\bk-nearest\b|\bsvm\b|\bneural\b|\bdeep learning\b|\bml\b|\bmachine learning\b|\bcross[- ]validation\b|\bcross_val\w*\b|\bgrid ?search\b|\btuning\b|\btuned\b|\btrain(?:ing)?[- ]?test\b|\btrain_test_split\b|\bepoch\w*\b|\bdropout\b|\blearning rate\b|\bhyperparameter\w*\b|\bpredict\w*\b|\bfeature importance\b|\bconfusion matrix\b|\bf1[- ]score\b|\bauc\b|\broc\b|\baccuracy\b|\bprecision\b|\brecall\b|\bsensitivity\b|\bspecificity\b|\bclassification\b"),
    ("random sampling", r"(?i)\brandom\b|\bshuffle\b|\bsampl\w*|\bbootstrap\b|\bpermut\w*|\bresampl\w*|\bdraw\w*|\bsimulat\w*\b"),
)
AMBIGUOUS = (
    ("unstated threshold", r"(?i)\bthreshold\b|\bcut[- ]?off\b|\bcriterion\b|\bcriteria\b|\bbased on .{0,20}analysis\b|\bseparat\w+ .{0,20}(?:from|into)\b|\bdefinition of\b|\bconsidered\b|\bqualif\w+ (?:as|by)\b|\bredundant\b|\bcompetitive\b|\bdominant\b|\bsignificant\b|\bmeaningful\b|\bappropriat\w+\b"),
    ("unjudged comparison", r"(?i)\bbetter\b|\bbest\b|\bworse\b|\bworst\b|\boptimal\b|\bideal\b|\bstrongest\b|\bimprovement\b|\bmuch more\b|\bmost (?:efficient|effective|popular|influential)\b"),
)
HARD_FAMILIES = ("ml_fit", "stat_test", "groupby", "lookup", "join")
ANSWER_TYPES = {"numeric": "numeric", "exact_short": "label", "exact_bool": "bool"}
STOP_WORDS = ("the", "a", "an", "of", "in", "is", "are", "for", "to", "and", "or", "on", "what", "which", "how", "many", "was", "were", "by", "that", "with", "as", "at", "it", "be", "from", "this", "there", "their", "has", "have", "had", "does", "do", "did")
NEAR_DUP_BAND = ((0.9, 0.8), (0.8, 0.6), (0.7, 0.5), (0.6, 0.4))
MIN_LEAK_LEN = 4
MAX_OUTPUT = 8000
CACHE_PATH = r"(?:\./)?(?:input/)?kaggle/datasets/[^\s\"':,)\]]+"
MACHINE_PATH = r"(?i)/(?:home|Users)/(?!user\b)[^\s\"':,)\]]+|/var/tmp/[^\s\"':,)\]]*|/mnt/[^\s\"':,)\]]+|/data/[^\s\"':,)\]]+"
SECRET = r"(?i)\b(?:sk-or-v1-|sk-|hf_|ghp_|gho_|xoxb-|AKIA)[A-Za-z0-9_\-]{8,}|\b[A-Za-z0-9_\-]*(?:api[_-]?key|token|secret)[A-Za-z0-9_\-]*\s*[=:]\s*[\"']?[A-Za-z0-9_\-]{12,}|\bBearer\s+[A-Za-z0-9._\-]{12,}"
HOME_PATH = r"(?i)/(?:home|Users)/(?!user\b)"
INPUT_PATH = r"(?<![\w/.\-])(?:\./)?input(?=/|['\"])"
SQL_KEYWORDS = ("select", "from", "where", "and", "or", "not", "in", "is", "null", "as", "on", "join", "left", "right", "inner", "outer", "group", "by", "order", "having", "limit", "distinct", "case", "when", "then", "else", "end", "like", "between", "asc", "desc")
TABLE_SUFFIX = r"(?i)\.(csv|tsv|parquet|json|jsonl|xlsx|xls|sqlite|db|txt|tif|png|jpg|jpeg|avro|feather|pickle|pkl|h5|parq)$"

# --------------------------------------------------------------------------------------------------------------------


def text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def compact(*items: Column) -> Column:
    """The items that are not null, as an array."""
    return F.array_compact(F.array(*items))


def normalise_question(c: Column) -> Column:
    marked = F.regexp_replace(F.lower(text(c)), r"[$`\\*_>]+", " ")
    return F.trim(F.regexp_replace(marked, r"[^a-z0-9]+", " "))


def tokens(c: Column) -> Column:
    """Sorted set of content words."""
    words = F.split(normalise_question(c), " ")
    return F.array_sort(F.array_except(F.array_distinct(words), F.array(*map(F.lit, (*STOP_WORDS, "")))))


def char_ngrams(c: Column, n: int = 5) -> Column:
    """Sorted set of the n-grams of the padded normal form; a shorter one is its own only n-gram."""
    padded = F.concat(F.lit(" "), normalise_question(c), F.lit(" "))
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded) - n + 1, F.lit(1))), lambda i: F.substr(padded, i, F.lit(n)))
    return F.array_sort(F.array_distinct(grams))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; 0 for two empty ones."""
    both = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(both.cast("double"), (F.size(a) + F.size(b) - both).cast("double")), F.lit(0.0))


def dataset_key(c: Column) -> Column:
    return F.element_at(F.split(F.lower(F.trim(text(c))), "/"), -1)


def slug(c: Column) -> Column:
    return F.regexp_replace(text(c), r"[^A-Za-z0-9_.-]", "_")


def source_row_key(c: Column) -> Column:
    return slug(F.regexp_replace(text(c), r"^ja_", ""))


def notebook(c: Column) -> Column:
    """An id without its last _qa_ part."""
    return F.regexp_replace(text(c), r"_qa_(?:(?!_qa_).)*$", "")


def file_key(files: Column) -> Column:
    """Sorted set of lower-case base names, so that equal sets are equal arrays."""
    return F.array_sort(F.array_distinct(F.transform(files, lambda f: F.lower(F.element_at(F.split(f, "/"), -1)))))


def number(c: Column) -> Column:
    """A number as plain decimal text says it, else null; unlike a cast, takes no suffix such as 1d."""
    return F.when(F.trim(c).rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), F.trim(c).try_cast("double"))


def whole_number(c: Column, key: str) -> Column:
    """The int at a key (letters) of a JSON object; null if there is none.

    An object of this key alone with an int in plain digits is read without a parser, which costs a fraction of its time;
    the parser gives the same for such texts and reads all others.
    """
    head = f'{{"{key}": '
    digits = F.substring(c, F.lit(len(head) + 1), F.length(c) - len(head) - 1)
    n = digits.try_cast("int")
    plain = c.startswith(head) & c.endswith("}") & (n.cast("string") == digits)
    return F.when(plain, n).otherwise(F.get_json_object(c, f"$.{key}").try_cast("int"))


def answers_agree(a: Column, b: Column) -> Column:
    """Within 1e-9 as numbers, else equal in normal form."""
    x, y = number(a), number(b)
    return F.when(x.isNotNull() & y.isNotNull(), F.abs(x - y) <= 1e-9).otherwise(normalise_question(a) == normalise_question(b))


def classify(c: Column) -> Column:
    """struct<mode, value>, null where the answer cannot be graded."""
    raw = F.trim(text(c))
    value = F.trim(F.regexp_replace(raw, r"[$,%]", ""))
    pair = lambda mode, v: F.struct(F.lit(mode).alias("mode"), v.alias("value"))
    return (
        F.when((raw == "") | (F.length(raw) > 60) | raw.rlike(NO_ANSWER) | raw.rlike(NOISY), F.lit(None))
        .when(F.lower(raw).isin("yes", "no"), pair("exact_bool", F.lower(raw)))
        .when(raw.rlike(NUMERIC), F.when(number(value).isNotNull(), pair("numeric", value)))
        .when(raw.rlike(LABEL), pair("exact_short", raw))
    )


def tolerance(mode: Column, value: Column) -> Column:
    """From the printed decimals of a numeric answer; 0 for others."""
    decimals = F.when(F.contains(value, F.lit(".")), F.length(F.split_part(value, F.lit("."), F.lit(2)))).otherwise(0)
    return F.when(mode == "numeric", F.least(F.greatest(F.pow(F.lit(10.0), -(decimals + 1)), F.lit(1e-4)), F.lit(0.05))).otherwise(0.0)


def lowered(c: Column, use: Callable[[Column], Column]) -> Column:
    """use(c in lower case), made lower once: the patterns then need not look at both cases."""
    return F.get(F.transform(F.array(F.lower(text(c))), use), F.lit(0))


def matching(q: Column, patterns: tuple[tuple[str, str], ...]) -> list[Column]:
    """For each pattern its name where the lower-case text matches it, else null."""
    return [F.when(q.rlike(p.removeprefix("(?i)")), F.lit(name)) for name, p in patterns]


def op_family(c: Column) -> Column:
    """The first family that matches, in order."""
    return lowered(c, lambda q: F.coalesce(*matching(q, FAMILIES), F.lit("other")))


def nondeterminism_reasons(c: Column) -> Column:
    return lowered(c, lambda q: compact(*matching(q, NONDETERMINISM)))


def ambiguous_words(c: Column) -> Column:
    return lowered(c, lambda q: compact(*matching(q, AMBIGUOUS)))


def ambiguity_reasons(question: Column, answer: Column, mode: Column) -> Column:
    words = F.filter(F.split(text(answer), r"[^A-Za-z0-9]+"), lambda w: F.length(w) > 3)
    q = F.lower(text(question))
    missing = F.when((mode == "exact_short") & F.exists(words, lambda w: ~F.contains(q, F.lower(w))), F.lit("label vocabulary not in question"))
    return F.array_compact(F.concat(ambiguous_words(question), F.array(missing)))


def answer_type(mode: Column) -> Column:
    known = F.coalesce(*(F.when(mode == k, F.lit(v)) for k, v in ANSWER_TYPES.items()))
    return F.coalesce(known, F.nullif(mode, F.lit("")), F.lit("unknown"))


def plain(c: Column) -> Column:
    """Lower case, without white space and the signs _ , % $."""
    return F.lower(F.regexp_replace(text(c), r"[\s,_%$]", ""))


def numbers_in(c: Column) -> Column:
    return F.regexp_extract_all(text(c), F.lit(r"(?<![\w.])-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?"), F.lit(0))


def leaks(answer: Column, prompt: Column, mode: Column | None = None, tol: Column | None = None) -> Column:
    """Ways in which a prompt gives the answer: array of answer-substring or answer-numeric:<first number that grades>."""
    a, mode = plain(answer), F.lit("numeric") if mode is None else mode
    gold, tol = number(F.regexp_replace(text(answer), r"[$,%]", "")), F.lit(1e-4) if tol is None else tol
    hit = F.get(F.filter(numbers_in(prompt), lambda x: F.abs(x.try_cast("double") - gold) <= F.greatest(tol, tol * F.abs(gold))), F.lit(0))
    return (
        F.when(F.length(a) < MIN_LEAK_LEN, F.array().cast("array<string>"))
        .when(F.contains(plain(prompt), a), F.array(F.lit("answer-substring")))
        .when((mode == "numeric") & hit.isNotNull(), F.array(F.concat(F.lit("answer-numeric:"), hit)))
        .otherwise(F.array().cast("array<string>"))
    )


def strip_prefix(c: Column) -> Column:
    """Without one leading ANSWER: mark."""
    return F.trim(F.regexp_replace(text(c), r"(?i)^[ \t]*answer[ \t]*:[ \t]*", ""))


def last_line(c: Column) -> Column:
    """Last line that is not blank, trimmed; empty if there is none."""
    lines = F.filter(F.transform(F.split(text(c), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.coalesce(F.try_element_at(lines, F.lit(-1)), F.lit(""))


def extract_code(c: Column) -> Column:
    """Body of the last fenced block, else the whole text."""
    blocks = F.regexp_extract_all(text(c), F.lit(r"(?is)```(?:python|py)?[ \t]*\n(.*?)```"), F.lit(1))
    return F.coalesce(F.try_element_at(blocks, F.lit(-1)), text(c))


def is_command(c: Column) -> Column:
    """Whether an answer looks like a shell command instead of a value."""
    return text(c).rlike(r"(?i)^\s*(echo|cat|python3?|printf|bash|sh|cd|ls|head|grep|awk|sed)\b|[|>]\s*\S+\.txt|&&")


def truncated(c: Column, limit: int = MAX_OUTPUT) -> Column:
    """struct<text, cut>: the head of an output, marked where it is cut."""
    cut = F.length(text(c)) > limit
    return F.struct(F.when(cut, F.concat(F.substring(text(c), 1, limit), F.lit("\n... [output truncated]"))).otherwise(text(c)).alias("text"), cut.alias("cut"))


def _tail(c: Column, pattern: str) -> Column:
    """Paths that match: those that end in a table's name become ./input/<name>, others ./input."""
    named = F.regexp_replace(c, rf"(?i:{pattern.removeprefix('(?i)')})(?<=/([^/\s\"':,)\]]{{1,120}}\.(?:csv|tsv|parquet|json|jsonl|xlsx|xls|sqlite|db|txt|tif|png|jpg|jpeg|avro|feather|pickle|pkl|h5|parq)))", "./input/$1")
    return F.regexp_replace(named, pattern, "./input")


def scrub(c: Column, secret_mark: str = "[secret]") -> Column:
    """Cache and machine paths become ./input or ./input/<table file>, secrets a mark of their own."""
    return F.regexp_replace(_tail(_tail(text(c), CACHE_PATH), MACHINE_PATH), SECRET, secret_mark.replace("$", r"\$"))


def machine_leaks(c: Column) -> Column:
    """Names of the rules that still match."""
    t = text(c)
    return compact(
        F.when(t.rlike(HOME_PATH), F.lit("home path")),
        F.when(F.contains(t, F.lit("/var/tmp/")) | F.contains(t, F.lit("/tmp/smol")), F.lit("scratch or cache path")),
        F.when(F.contains(t, F.lit("kaggle/datasets")), F.lit("cache layout")),
        F.when(t.rlike(SECRET), F.lit("api key or token")),
    )


def same_value(a: Column, b: Column) -> Column:
    """Equal in plain form, or as numbers within 1e-4 (relative or absolute)."""
    x, y = F.trim(F.regexp_replace(F.trim(text(a)), r"^\.+|\.+$", "")), F.trim(F.regexp_replace(F.trim(text(b)), r"^\.+|\.+$", ""))
    p, q = number(x), number(y)
    near = F.coalesce(F.abs(p - q) <= F.greatest(F.lit(1e-4), F.lit(1e-4) * F.abs(p)), F.lit(False))
    return (x != "") & (y != "") & ((plain(x) == plain(y)) | near)


def verdict(c: Column, fields: tuple[str, ...] = ("answerable", "unambiguous", "determinate", "requires_compute")) -> Column:
    """struct of nullable booleans, reason (400 characters at most) and error, from the first {...} of a reply."""
    block = F.regexp_extract(text(c), r"(?s)\{.*\}", 0)
    parsed = F.from_json(block, ", ".join(f"{f} string" for f in (*fields, "reason")))
    flag = lambda f: F.when(F.lower(parsed[f]) == "true", True).when(F.lower(parsed[f]) == "false", False)
    none = F.coalesce(*(parsed[f] for f in (*fields, "reason"))).isNull()
    return F.struct(*(flag(f).alias(f) for f in fields), F.substring(F.coalesce(parsed["reason"], F.lit("")), 1, 400).alias("reason"), F.when(block == "", "no object in reply").when(none, "unreadable object").alias("error"))


def sha16(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 16)


def sql_statements(c: Column) -> Column:
    return F.regexp_extract_all(text(c), F.lit(r"(?is)\b(select\b.+?\bfrom\b.+?)(?=;|\"\"\"|'''|$)"), F.lit(1))


def sql_predicates(statement: Column) -> Column:
    where = F.regexp_extract(statement, r"(?is)\bwhere\b(.*?)(?:\bgroup\s+by\b|\border\s+by\b|\blimit\b|\bhaving\b|$)", 1)
    return F.filter(F.transform(F.split(where, r"(?i)\b(?:and|or|not)\b"), lambda x: F.trim(x)), lambda x: x != "")


def sql_columns(statement: Column) -> Column:
    """Sorted names in the select list, the tables and the conditions of a statement, without keywords, numbers and quoted texts."""
    bare = F.regexp_replace(text(statement), r"'[^']*'", " ")
    clause = F.regexp_replace(bare, r"(?is)\b(?:group\s+by|order\s+by|limit|having)\b.*$", " ")
    words = F.array_distinct(F.regexp_extract_all(clause, F.lit(r"[A-Za-z_][A-Za-z0-9_]*"), F.lit(0)))
    return F.array_sort(F.filter(words, lambda w: ~F.lower(w).isin(*SQL_KEYWORDS)))


def sql_operator(predicate: Column) -> Column:
    """!= for a condition that excludes, else ==."""
    return F.when(text(predicate).rlike(r"(?i)\bnot\s+in\b|<>|!="), "!=").otherwise("==")


def sandbox_paths(c: Column, folder: str = "/home/user/input") -> Column:
    """./input and input/ as the sandbox names the folder."""
    return F.regexp_replace(text(c), INPUT_PATH, folder)


def one_line(c: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(text(c), r"\s+", " "))


def hint_fields(reply: Column, where: tuple[str, ...] = ("l2", "L2", "where", "where_to_look"), how: tuple[str, ...] = ("l3", "L3", "how", "method")) -> Column:
    """struct<l2 map<string,string>, l3> of a JSON reply: the fields under any of their names, at the top or one level down.

    A reply that is itself files, columns and filters is the first field. What is not there is empty.
    """
    top = F.from_json(text(reply), "map<string,string>")
    inner = F.filter(F.transform(F.map_values(top), lambda v: F.from_json(v, "map<string,string>")), lambda m: F.size(F.coalesce(m, F.create_map().cast("map<string,string>"))) > 0)
    levels = F.concat(F.array(top), F.coalesce(inner, F.array().cast("array<map<string,string>>")))
    first = lambda names, use: F.get(F.filter(F.flatten(F.transform(levels, lambda m: F.array(*(use(F.try_element_at(m, F.lit(n))) for n in names)))), lambda x: x.isNotNull()), F.lit(0))
    as_map = lambda v: F.when(v.startswith("{"), F.from_json(v, "map<string,string>"))
    bare = lambda m: F.map_filter(m, lambda k, v: k.isin("files", "columns", "filters"))
    itself = F.get(F.filter(F.transform(levels, bare), lambda m: F.size(m) > 0), F.lit(0))
    empty = F.create_map().cast("map<string,string>")
    return F.struct(F.coalesce(first(where, as_map), itself, empty).alias("l2"), F.coalesce(first(how, lambda v: F.when(~v.startswith("{"), v)), F.lit("")).alias("l3"))


def phrase(n: Column, steps: tuple[tuple[float, str], ...]) -> Column:
    """The phrase of the first bound above n, else the last."""
    out = F.lit(steps[-1][1])
    for limit, words in reversed(steps[:-1]):
        out = F.when(n < limit, F.lit(words)).otherwise(out)
    return out


def column_label(c: Column) -> Column:
    return F.when(c == "Unnamed: 0", "an unnamed first column").when(c.startswith("Unnamed:"), "an unnamed column").otherwise(c)


def submission(value: Column) -> Column:
    """struct<command, refusal>: a shell command that writes the value, or why there is none."""
    refusal = F.when(F.contains(value, F.lit("\n")), "several lines").when(value.rlike(r"^-"), "looks like a flag").when(F.trim(value) == "", "empty")
    quoted = F.concat(F.lit("'"), F.replace(value, F.lit("'"), F.lit("'\"'\"'")), F.lit("'"))
    return F.struct(F.when(refusal.isNull(), F.concat(F.lit("echo "), quoted, F.lit(" > answer.txt"))).alias("command"), refusal.alias("refusal"))


def token_agreement(output: Column, target: Column) -> Column:
    """Share of the target's tokens that stand at the same place in the output."""
    a, b = F.split(F.trim(text(output)), r"\s+"), F.split(F.trim(text(target)), r"\s+")
    return F.size(F.filter(F.sequence(F.lit(0), F.size(b) - 1), lambda i: F.get(a, i) == F.get(b, i))) / F.size(b)
