"""Categories and fingerprints of job failures, as Column expressions over their error text.

Categories: A parse errors, B output and anything else, C network, D timeouts, E page state, F1 crash, F2 killed by the
time limit, F3 infrastructure, G result against its contract. The order of the checks is their meaning.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from harrow.functions.regex import first_label, grab, has, has_any, java, let, strip

# What error texts hold, by category.
PARSE_ERRORS = (r"^SyntaxError:", r"^IndentationError:", r"^TabError:", r"^ModuleNotFoundError:", r"^ImportError:")
TIME_LIMIT = (r"Script execution timed out after \d+ seconds", r"Function timed out after \d+ seconds")
INFRASTRUCTURE = (
    r"[Ee]xecutable doesn'?t exist", r"Host system is missing dependencies", r"Cannot open display", r"Failed to connect to the bus", r"No space left on device",
    r"Too many open files", r"\bEMFILE\b", r"No usable sandbox", r"Event loop is closed", r"BrowserType\.\w+:.*Connection timed out", r"Maximum argument depth exceeded",
    r"/dev/shm", r"libnss3\.so|libatk-1\.0\.so|libxss\.so", r"Cannot create directory", r"mkdtemp", r"BrowserType\.launch|BrowserType\.launch_persistent_context",
)
CRASHES = (
    r"Page crashed", r"Target crashed", r"Target page, context or browser has been closed", r"Browser has been closed", r"Browser closed", r"Page closed", r"Context closed",
    r"Navigation failed because page crashed", r"Connection closed while reading from the driver", r"Playwright connection closed", r"Socket closed", r"Socket error",
    r"The object has been collected to prevent unbounded heap growth", r"(?:patchright|playwright)\._impl\._errors\.TargetClosedError",
)
KILLED_CODES, CRASH_CODES = (137, -9), (139, 134, 135, -11, -6, -7)
NAVIGATION = ("Page.goto", "Page.reload", "Page.go_back", "Page.go_forward", "Frame.goto")
TIMEOUT = r"(\b[A-Z]\w+\.\w+):\s+Timeout\s+\d+ms\s+exceeded"
NET_ERROR = r"(net::ERR_\w+)"
PAGE_STATE = (
    r"Execution context was destroyed", r"Frame was detached", r"Navigating frame was detached", r"Navigation interrupted by another navigation",
    r"Frame is currently attempting a navigation", r"Unable to retrieve content because the page is navigating", r"Frame for this navigation request is not available",
    r"strict mode violation:", r"Cannot evaluate.*page has an open JavaScript dialog", r"Open JavaScript dialog prevents evaluation",
)
CALL_LOG_STATE = (
    r"intercepts pointer events", r"element is not visible", r"element is not enabled", r"element is not stable", r"Element is outside of the viewport",
    r"Element is not attached to the DOM", r"Node is detached", r"Clicking the checkbox did not change its state", r"Cannot set input files to detached element",
    r"Element is not an <input>", r"Element is not a <select>",
)
NO_OUTPUT = (r"Script did not produce output file", r"Script produced empty output file", r"Script output is not valid JSON")
NEVER_REPAIRED = ("Execution context was destroyed", "Frame was detached")
ROUTE_WRAPPER = (
    r'"([^"]*?)"\s+while running route callback\.\s*Consider awaiting .?page\.unroute_all\(behavior=.?ignoreErrors.?\).?\s*'
    r"before the end of the test to ignore remaining routes in flight\."
)
RETURN_MARKER = "_RETURN_VALUE_"

# Shapes of error lines.
DRIVER_LINE = r"(?:patchright|playwright)\._impl\._errors\.\w+:\s*((?:Page|Locator|Frame|ElementHandle|BrowserContext|Browser|BrowserType)\.\w+):\s*(.*)"
PYTHON_ERROR = (
    r"^(\w+(?:\.\w+)*Error|KeyError|IndexError|StopIteration|AssertionError|EOFError|RecursionError|OverflowError|ZeroDivisionError|NameError|UnboundLocalError):\s*(.*)"
)
ANY_ERROR = r"^([A-Z]\w*(?:Error|Exception|Warning|Interrupt)):\s*(.*)"
SELECTORS = (
    r"""locator\(["']([^"']+)["']\)""",
    r"""wait_for_selector\(\s*['"]([^'"]+)['"]""",
    r"""(?:click|fill|hover|dblclick|tap|check|uncheck|press|type|focus|blur|select_option|set_input_files|dispatch_event|select_text|scroll_into_view_if_needed|"""
    r"""text_content|inner_text|inner_html|get_attribute|input_value|query_selector|query_selector_all)\(\s*['"]([^'"]+)['"]""",
)
JS_ERRORS = ("TypeError", "ReferenceError", "SyntaxError", "RangeError", "URIError")
STATE_NAMES = (
    (r"intercepts pointer events", "pointer_intercept"), (r"element is not visible", "not_visible"), (r"element is not enabled", "not_enabled"), (r"element is not stable", "not_stable"),
    (r"Element is outside of the viewport", "outside_viewport"), (r"Element is not attached|Node is detached", "detached"), (r"strict mode violation:", "strict_mode"),
    (r"Execution context was destroyed", "context_destroyed"), (r"Frame was detached|Navigating frame was detached", "frame_detached"), (r"Navigation interrupted", "nav_interrupted"),
    (r"Frame is currently attempting a navigation", "frame_navigating"), (r"Unable to retrieve content.*navigating", "content_during_nav"),
    (r"Frame for this navigation request", "frame_not_available"), (r"[Cc]annot evaluate.*JavaScript dialog|JavaScript dialog prevents evaluation", "dialog_blocking"),
    (r"Clicking the checkbox did not change", "checkbox_unchanged"), (r"Cannot set input files to detached", "input_files_detached"), (r"Element is not an <", "wrong_element_type"),
)
INFRASTRUCTURE_NAMES = (
    (r"[Ee]xecutable doesn'?t exist", "BrowserNotFound"), (r"No space left on device", "DiskFull"), (r"Too many open files|EMFILE", "TooManyFiles"),
    (r"No usable sandbox", "SandboxError"), (r"Cannot open display", "NoDisplay"),
)
CRASH_NAMES = (
    (r"TargetClosedError", "TargetClosedError"), (r"Page crashed|Target crashed", "PageCrash"), (r"Browser.*closed", "BrowserClosed"),
    (r"Connection closed|Playwright connection", "ConnectionLost"), (r"Socket closed|Socket error", "SocketError"),
)


def strip_route_wrapper(stderr: Column) -> Column:
    """Without the wrapper that route callbacks put around an error, the quoted error included."""
    return F.when(F.contains(stderr, F.lit("while running route callback")), F.regexp_replace(stderr, java(ROUTE_WRAPPER, "s"), "")).otherwise(stderr)


def classify_error(stderr: Column, exit_code: Column, schema_error: Column, stdout: Column | None = None) -> Column:
    """The category of a failure, A to G."""
    raw = F.coalesce(stderr, F.lit(""))
    out = F.coalesce(stdout, F.lit("")) if stdout is not None else F.lit("")
    contract = F.coalesce(schema_error, F.lit("")) != ""
    code = lambda codes: F.coalesce(exit_code.isin(*codes), F.lit(False))
    null_output = (strip(out) == "") | (out.contains("null") & out.contains(RETURN_MARKER))

    def decided(s: Column) -> Column:
        text, silent, timed_out = s["text"], s["silent"], s["timed_out"]
        log = F.when(F.instr(text, "Call log:") > 0, F.substr(text, F.instr(text, "Call log:")))
        return (
            F.when(contract & silent & F.coalesce(exit_code == 0, F.lit(True)), "G")
            .when(has_any(text, PARSE_ERRORS, "m"), "A")
            .when(has_any(text, TIME_LIMIT), "F2")
            .when(code(KILLED_CODES) | has_any(text, INFRASTRUCTURE), "F3")
            .when(code(CRASH_CODES) | has_any(text, CRASHES), "F1")
            .when(has(text, NET_ERROR) | F.coalesce(timed_out.isin(*NAVIGATION), F.lit(False)), "C")
            .when(has_any(text, PAGE_STATE) | (timed_out.isNotNull() & has_any(log, CALL_LOG_STATE)), "E")
            .when(timed_out.isNotNull(), "D")
            .when(has_any(text, NO_OUTPUT) | (F.coalesce(exit_code == 0, F.lit(False)) & (strip(text) == "") & null_output), "B")
            .when(contract & silent, "G")
            .otherwise("B")
        )

    text = strip_route_wrapper(raw)
    timed_out = F.when(F.contains(text, F.lit("Timeout")), grab(text, TIMEOUT))
    return let(F.struct(text.alias("text"), (strip(raw) == "").alias("silent"), timed_out.alias("timed_out")), decided)


def selector_of(text: Column) -> Column:
    """The selector an error speaks of: from its call log, a wait, or an action."""
    return F.coalesce(*[grab(text, p) for p in SELECTORS])


def extract_fingerprint(stderr: Column, category: Column, schema_error: Column) -> Column:
    """struct<category, error_type, method, target>; what can't be read is null."""
    text, contract = F.coalesce(stderr, F.lit("")), F.coalesce(schema_error, F.lit(""))
    method, detail = grab(text, DRIVER_LINE, 1, "s"), strip(grab(text, DRIVER_LINE, 2, "s"))
    python = F.coalesce(grab(text, PYTHON_ERROR, 1, "m"), grab(text, ANY_ERROR, 1, "m"))
    said = F.coalesce(grab(text, PYTHON_ERROR, 2, "m"), grab(text, ANY_ERROR, 2, "m"))
    timed_out, net, selector = grab(text, TIMEOUT), grab(text, NET_ERROR), selector_of(text)
    line = strip(F.substring_index(detail, "\n", 1))
    short = F.when(F.length(line) > 60, F.concat(F.left(line, F.lit(57)), F.lit("..."))).otherwise(line)
    js = F.when(has(detail, rf"(?:{'|'.join(JS_ERRORS)}):\s*(.*)"), F.coalesce(*[F.when(detail.contains(e), F.lit(f"JS.{e}")) for e in JS_ERRORS]))
    nothing = F.lit(None).cast("string")
    made = lambda error_type, how, target: F.struct(category.alias("category"), error_type.alias("error_type"), how.alias("method"), target.alias("target"))

    minimum, field, kind = (grab(contract, p, g) for p, g in ((r"[Ee]xpected at least (\d+) items?, got (\d+)", 1), (r"[Mm]issing (?:required )?field:?\s*['\"]?(\w+)['\"]?", 1), (r"[Ee]xpected (\w+) for field ['\"]?(\w+)['\"]?, got (\w+)", 2)))
    of_contract = F.coalesce(F.concat(F.lit("item_count < "), minimum), F.concat(F.lit("missing field: "), field), F.concat(F.lit("type mismatch: "), kind))
    state = first_label(text, STATE_NAMES)
    of_state = F.coalesce(
        F.when(state == "pointer_intercept", F.concat(F.lit("<"), grab(text, r"<(\w+)[^>]*>(?:</\w+>)?\s*intercepts pointer events"), F.lit(">"))),
        F.when(state == "strict_mode", F.concat(F.lit("resolved_to_"), grab(text, r"strict mode violation:\s*\w*\s*resolved to (\d+) elements"))),
        selector,
    )
    of_runtime = F.coalesce(
        F.when(method.isNull() & (python == "AttributeError"), grab(said, r"has no attribute ['\"](\w+)['\"]")),
        F.when(method.isNull() & (python == "KeyError"), grab(text, r"KeyError:\s*['\"]([^'\"]+)['\"]")),
        selector,
    )
    crash = F.coalesce(first_label(text, CRASH_NAMES), F.lit("ProcessDeath"))
    infrastructure = F.coalesce(first_label(text, INFRASTRUCTURE_NAMES), F.lit("InfrastructureError"))
    return (
        F.when(category == "G", made(F.lit("SchemaValidationError"), nothing, of_contract))
        .when(category == "A", made(python, nothing, grab(said, r"No module named ['\"]([^'\"]+)['\"]")))
        .when(category == "F2", made(F.lit("SubprocessTimeout"), nothing, F.concat(grab(text, r"timed out after (\d+) seconds"), F.lit("s"))))
        .when(category == "F3", made(infrastructure, nothing, nothing))
        .when(category == "F1", made(crash, method, nothing))
        .when(category == "C", made(F.coalesce(net, F.when(timed_out.isNotNull(), "TimeoutError")), F.coalesce(F.when(net.isNull(), timed_out), method), F.when(net.isNotNull(), grab(text, r"net::ERR_\w+ at (\S+)"))))
        .when(category == "E", made(state, F.coalesce(method, timed_out), of_state))
        .when(category == "D", made(F.lit("TimeoutError"), timed_out, selector))
        .otherwise(made(F.when(method.isNotNull(), F.coalesce(js, short)).otherwise(python), method, of_runtime))
    )


def compare_fingerprints(a: Column, b: Column) -> Column:
    """none, same_category, same_kind or exact. Two unknown targets are equal, a known and an unknown one aren't."""
    same = lambda f: a[f].eqNullSafe(b[f])
    return F.when(~same("category"), "none").when(~(same("error_type") & same("method")), "same_category").when(same("target"), "exact").otherwise("same_kind")


def error_summary(error: Column) -> Column:
    """The last line that isn't blank, 120 characters at most; null if there is none."""
    lines = F.filter(F.split(error, "\n"), lambda x: strip(x) != "")
    last = strip(F.try_element_at(lines, F.lit(-1)))
    return F.when(F.length(last) > 120, F.concat(F.left(last, F.lit(117)), F.lit("..."))).otherwise(last)


def exception_name(category: Column) -> Column:
    """What kind of exception a category is raised as."""
    return F.when(category.isin("D", "F2"), "timeout").when(category == "G", "validation").when(category == "F3", "base").otherwise("runtime")


def is_transient(status: Column) -> Column:
    """Whether a failed call may succeed when repeated: 429 or a server error."""
    return F.coalesce((status == 429) | (status >= 500), F.lit(False))
