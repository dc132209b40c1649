"""SQL counterparts of the registered queries, for an independent engine with RE2 regexes.

The texts are put together from the rule catalogue, so that both engines judge by the same patterns. A look-ahead, which RE2
lacks, is asked of what follows the last place where the rest of the pattern matches.
"""

from __future__ import annotations

from auditloom.functions.text import LINE_END
from auditloom.operators import architecture as A
from auditloom.operators import lines as L
from auditloom.operators import quality as Q
from auditloom.plans import rules as R

CODE = "code as (select distinct repo, file_path as path, name, ext, size, content from source_files)"
CONTEXTS = "code as (select distinct repo, file_path || '#' || cast(finding_id as varchar) as path, context as content from secret_findings)"
SNIPPETS = "code as (select distinct repo, file_path || '#' || cast(finding_id as varchar) as path, code_snippet as content from vulnerability_findings)"
PATHS = "code as (select distinct repo, file_path as path from (select repo, file_path from secret_findings union all select repo, file_path from vulnerability_findings union all select repo, file_path from performance_findings union all select repo, 'certs/server.pem' from repos where project_type = 'cli'))"
# Snippets with a line after them that performance rules look for, or nearly so, as no table holds such lines.
SEEDED = """concat(coalesce(code_snippet, ''), chr(10), case lower(coalesce(severity, '')) when 'critical' then 'rows = session.query(Item).all()' when 'high' then 'rows = Item.objects.all()[0:20]' when 'medium' then 'items.order_by(name)' else 'SELECT * FROM items' end)"""
SLOW = f"code as (select distinct repo, file_path || '#' || cast(finding_id as varchar) as path, {SEEDED} as content from vulnerability_findings)"
COMMITS = "commits_ as (select distinct commit_id, repo, message, author, commit_date, files_changed, insertions, deletions from commits)"
NOW = "2026-06-01 00:00:00"


def text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


SPLIT = f"string_split_regex(content, {text(LINE_END)})"
LISTED = f"listed as (select repo, path, case when content is null or content = '' then []::varchar[] when {SPLIT}[-1] = '' then {SPLIT}[:-2] else {SPLIT} end as l from code)"
LINES = LISTED + ", lines as (select repo, path, i as line_no, l[i] as line from (select repo, path, l, unnest(range(1, len(l) + 1)) as i from listed))"
BARE = r"regexp_replace(line, '^\s+|\s+$', '', 'g')"
MANIFESTS = """
select repo, 'requirements.txt' as path, concat('# pinned', chr(10), 'flask==', cast(length(repo) as string), '.1', chr(10), 'requests', chr(10), '-r base.txt', chr(10), 'pandas>=2.0', chr(10), 'uvicorn[standard]>=0.3', chr(10)) as content from repos
union all select repo, 'package.json' as path, concat('{"dependencies": {"express": "^4.', cast(length(repo) as string), '.0", "react": "latest"}, "devDependencies": {"Flask": "~1.0"}}') as content from repos where primary_language is not null
union all select repo, 'Gemfile' as path, concat('source "https://gems.invalid"', chr(10), 'gem "rails", "~> 7.', cast(length(repo) as string), '"', chr(10), 'gem "puma"', chr(10)) as content from repos where team is not null
union all select repo, 'app.csproj' as path, '<Project><PackageReference Include="Serilog" Version="3.1.1" /><PackageReference Include="Dapper" /></Project>' as content from repos where project_type = 'cli'
union all select repo, 'Pipfile' as path, concat('[packages]', chr(10), 'name = "x"', chr(10), 'celery = "~=', cast(length(repo) as string), '.2"', chr(10), 'boto = "*"', chr(10)) as content from repos
union all select repo, 'pyproject.toml' as path, concat('[project]', chr(10), 'dependencies = [', chr(10), '  "httpx>=0.', cast(length(repo) as string), '",', chr(10), '  "rich",', chr(10), ']', chr(10), 'other = [', chr(10), '  "no"', chr(10), ']', chr(10)) as content from repos
union all select repo, 'Cargo.toml' as path, concat('[package]', chr(10), 'name = "x"', chr(10), '[dependencies]', chr(10), 'serde = "1.', cast(length(repo) as string), '"', chr(10), 'axum = "0.8"', chr(10), '[profile]', chr(10), 'q = "1"', chr(10)) as content from repos
union all select repo, 'pom.xml' as path, concat('<dependency><groupId>org.x</groupId><artifactId>core</artifactId><version>', cast(length(repo) as string), '</version></dependency><dependency>', chr(10), '<groupId>org.x</groupId><artifactId>web</artifactId></dependency>') as content from repos
union all select repo, 'build.gradle' as path, concat('implementation "org.y:core:', cast(length(repo) as string), '.0"', chr(10), 'api "org.y:api"', chr(10), 'compile "none"', chr(10)) as content from repos
union all select repo, 'go.mod' as path, concat('module m', chr(10), 'require (', chr(10), chr(9), 'a.b/c v', cast(length(repo) as string), '.0', chr(10), chr(9), '// no', chr(10), ')', chr(10), 'require d.e/f v2', chr(10)) as content from repos
union all select repo, 'composer.json' as path, concat('{"require": {"php": "8", "a/b": "^', cast(length(repo) as string), '"}, "require-dev": {"c/d": "1"}}') as content from repos
union all select repo, 'pubspec.yaml' as path, concat('name: x', chr(10), 'dependencies:', chr(10), '  http: ^', cast(length(repo) as string), '.0', chr(10), 'dev_dependencies:', chr(10), '  t: 1', chr(10)) as content from repos
union all select repo, 'web/package.json' as path, concat('{"dependencies": {"vue": "', cast(length(repo) as string), '"}}') as content from repos
"""


def matches(column: str, pattern: str) -> str:
    """`pattern` found in `column`; a trailing look-ahead for what must not follow is asked of the rest."""
    head, ahead, tail = pattern.partition("(?!.*")
    if not ahead:
        return f"regexp_matches({column}, {text(pattern)})"
    flags = head[: head.index(")") + 1] if head.startswith("(?i") else ""
    return f"(regexp_matches({column}, {text(head)}) and not regexp_matches(regexp_replace({column}, {text(flags + '^.*' + head[len(flags) :])}, ''), {text(flags + tail[:-1])}))"


def any_match(column: str, patterns) -> str:
    return "(" + " or ".join(matches(column, p) for p in patterns) + ")"


def findings(source: str, catalogue: list[R.Rule], columns: str = "repo, path, line_no, rule, rule_type, severity, cwe, context") -> str:
    """A query of the findings of a catalogue, with the lines around them."""
    found = " union all ".join(f"select *, {r.place} as rule, {text(r.kind)} as rule_type, {text(r.severity)} as severity, {text(r.cwe)} as cwe from framed where {any_match('line', r.patterns)}" for r in catalogue)
    framed = "framed as (select *, concat_ws(chr(10), lag(line) over w, line, lead(line) over w) as context from lines window w as (partition by repo, path order by line_no))"
    return f"with {source}, {LINES}, {framed}, found as ({found}) select {columns} from found"


def advised() -> str:
    """The findings of the three catalogues, each with the sentences of its rule."""
    parts = []
    for source, rules in ((CONTEXTS, R.SECRET_RULES), (SNIPPETS, R.VULNERABILITY_RULES), (SLOW, R.PERFORMANCE_RULES)):
        said = ", ".join(f"({r.place}, {text(r.meaning)}, {text(r.advice)})" for r in rules)
        parts.append(f"select repo, path, line_no, rule_type, description, recommendation from ({findings(source, rules)}) join (values {said}) v(place, description, recommendation) on rule = place")
    return " union all ".join(parts)


LOC = f"with {CODE}, {LINES}, counted as (select repo, path, count(*) as loc from (select repo, path, {BARE} as bare from lines) where bare <> '' and not ({' or '.join(f'starts_with(bare, {text(p)})' for p in L.NO_CODE)}) group by repo, path), loc_per_file as (select code.repo, code.path, code.ext, code.content, coalesce(loc, 0) as loc from (select distinct repo, path, ext, content from code) code left join counted using (repo, path))"
DUPLICATION = f"with {CODE}, {LINES}, kept as (select repo, {BARE} as line from lines), counted as (select repo, line from kept where length(line) >= 10 and not ({' or '.join(f'starts_with(line, {text(p)})' for p in L.NO_DUPLICATE)})) select repo, count(*) as lines, count(*) - count(distinct line) as duplicated, round((count(*) - count(distinct line)) * 100 / count(*), 1) as percent from counted group by repo"
LANGUAGE = "case lower(ext) " + " ".join(f"when {text(e)} then {text(l)}" for e, l in A.LANGUAGES.items()) + " end"
LANGUAGES = f"with {CODE}, counted as (select repo, {LANGUAGE} as language, count(*) as file_count from code where {LANGUAGE} is not null group by 1, 2)"
LAYER = "case " + " ".join("when " + " or ".join(f"contains(lower(directory), {text(w)})" for w in words) + f" then {text(n)}" for n, words in A.LAYERS.items()) + " else 'Other' end"
SCRIPT = f"1.0 + len(regexp_extract_all(content, {text(Q.BRANCH)}))"
METRICS = f"metrics as (select repo, path, loc, {SCRIPT} as complexity from loc_per_file where ext in ('.js', '.ts') and content is not null)"
MAINTAINED = "case when loc = 0 then 100.0 else round(least(100.0, greatest(0.0, 221 - 5.2 * sqrt(complexity) - 0.23 * loc - 16.2 * sqrt(loc))), 1) end"
DEBT = "case when complexity > 15 then (complexity - 15) * 5 when complexity > 10 then (complexity - 10) * 2 else 0 end + case when loc > 500 then (loc - 500) * 0.1 + 5 else 0 end"


def all_frameworks() -> str:
    """Frameworks by manifest, else by the words of a source, else by suffix."""
    known = f"lower(ext) in ({', '.join(map(text, A.LANGUAGES))})"
    base = f"with {CODE}, manifests as ({MANIFESTS}), texts as (select repo, case when path = 'requirements.txt' then lower(content) else content end as t from manifests where path in ({', '.join(map(text, A.MANIFESTS))})), sources as (select repo, lower(ext) as ext, coalesce(content, '') as c from code where {known}), "
    found = []
    for n, (words, imports, suffixes) in A.FRAMEWORKS.items():
        found.append(f"select distinct repo, {text(n)} as framework, 1 as rank from texts where {' or '.join(f'contains(t, {text(w)})' for w in words)}")
        if imports:
            found.append(f"select distinct repo, {text(n)}, 2 from sources where {' or '.join(f'contains(c, {text(w)})' for w in imports)}")
        if suffixes:
            found.append(f"select distinct repo, {text(n)}, 3 from sources where ext in ({', '.join(map(text, suffixes))})")
    return base + f"found as ({' union all '.join(found)}) select repo, framework, case min(rank) when 1 then 'manifest' when 2 then 'import' else 'suffix' end as evidence from found group by repo, framework"


def sure() -> str:
    return " or ".join(f"framework = {text(n)} and ({' or '.join(f'contains(repo, {text(w)})' for w in words[0])})" for n, words in A.FRAMEWORKS.items())


def kinds() -> str:
    """The kind of project with most points, ties in the order of the kinds."""
    has = lambda *names: "(" + " or ".join(f"list_contains(dirs, {text(x)})" for x in names) + ")"
    root = lambda *names: "(" + " or ".join(f"list_contains(roots, {text(x)})" for x in names) + ")"
    n = lambda test, points: f"case when {test} then {points} else 0 end"
    points = {
        "microservices": [n(root("docker-compose.yml", "docker-compose.yaml"), 2), n(has("services"), 3), n(has("k8s", "kubernetes"), 2)],
        "api_rest": [*(n(has(x), 2) for x in ("api", "routes", "controllers", "endpoints")), n(f"{has('public')} and {has('src')}", 1)],
        "mobile": [n(root("pubspec.yaml"), 3), n(has("android", "ios"), 2), n("dart", 2)],
        "desktop": [n("cs", 1)],
        "cli": ["2 * cli"],
        "library": [n(root("setup.py", "setup.cfg"), 1), n(f"{has('lib')} and not {has('src')}", 1)],
    }
    known = f"lower(ext) in ({', '.join(map(text, A.LANGUAGES))})"
    spoken = " or ".join(f"contains(content, {text(w)})" for w in A.CLI_WORDS)
    row = f"select repo, list(distinct case when contains(path, '/') then split_part(path, '/', 1) end) filter (contains(path, '/')) as dirs, list(distinct path) filter (not contains(path, '/')) as roots, bool_or(lower(ext) = '.dart') as dart, bool_or(lower(ext) in ('.cs', '.xaml') and {known}) as cs, count(*) filter ({known} and coalesce({spoken}, false)) as cli from code group by repo"
    scored = " union all ".join(f"select repo, {text(k)} as project_type, {A.KINDS.index(k)} as place, {' + '.join(v)} as points from row_" for k, v in points.items())
    return f"with {CODE}, row_ as (select repo, coalesce(dirs, []::varchar[]) as dirs, coalesce(roots, []::varchar[]) as roots, dart, cs, cli from ({row})), scored as ({scored}), best as (select *, row_number() over (partition by repo order by points desc, place) as nth from scored) select repo, case when points = 0 then 'monolith' else project_type end as project_type from best where nth = 1"


def frameworks() -> str:
    texts = f"with manifests as ({MANIFESTS}), texts as (select repo, case when path = 'requirements.txt' then lower(content) else content end as t from manifests where path in ({', '.join(map(text, A.MANIFESTS))}))"
    return texts + " " + " union ".join(f"select distinct repo, {text(n)} as framework, 'manifest' as evidence from texts where {' or '.join(f'contains(t, {text(w)})' for w in words[0])}" for n, words in A.FRAMEWORKS.items())


REQUIREMENT = r"^([a-zA-Z0-9_.-]+)\s*([><=!~]+.*)?$"
GEM, TAG = r'''gem\s+["']([^"']+)["'](?:,\s*["']([^"']+)["'])?'''.replace("'", "''"), r'''<PackageReference\s+Include="([^"]+)"(?:\s+Version="([^"]+)")?'''
POM = r"<dependency>\s*<groupId>([^<]+)</groupId>\s*<artifactId>([^<]+)</artifactId>\s*(?:<version>([^<]+)</version>)?"
GRADLE = r'''(?:implementation|api|compile|testImplementation)\s+["']([^"']+)["']'''.replace("'", "''")
PIPENV = r'''^(\w[\w.-]*)\s*=\s*["']([^"'\n]+)["']'''.replace("'", "''")
DEPENDENCIES = f"""with manifests as ({MANIFESTS}),
pip as (select repo, path, 'pip' as manager, 1 as place, i as seq, line from (select repo, path, string_split(content, chr(10)) as l, unnest(range(1, len(string_split(content, chr(10))) + 1)) as i, string_split(content, chr(10))[i] as line from manifests where path = 'requirements.txt')),
npm as (select repo, path, s, json_extract(content, '$."' || s || '"') as j, case path when 'package.json' then 'npm' when 'composer.json' then 'composer' else 'npm nested' end as manager, case path when 'package.json' then 0 when 'composer.json' then 9 else 12 end as place from manifests, (values ('dependencies', 'package.json'), ('devDependencies', 'package.json'), ('require', 'composer.json'), ('require-dev', 'composer.json')) v(s, f) where ends_with(path, f)),
ml as (select repo, path, l, i, l[i] as line, trim(l[i], ' ' || chr(9)) as bare from (select repo, path, string_split(content, chr(10)) as l, unnest(range(1, len(string_split(content, chr(10))) + 1)) as i from manifests)),
pairs as (select repo, path, manager, place, unnest(n) as name, unnest(v) as version, unnest(range(0, len(n))) as i from (
select repo, path, 'bundler' as manager, 8 as place, regexp_extract_all(content, '{GEM}', 1) as n, regexp_extract_all(content, '{GEM}', 2) as v from manifests where path = 'Gemfile'
union all select repo, path, 'nuget', 11, regexp_extract_all(content, '{TAG}', 1), regexp_extract_all(content, '{TAG}', 2) from manifests where ends_with(path, '.csproj')
union all select repo, path, 'maven', 5, list_transform(list_zip(regexp_extract_all(content, '{POM}', 1), regexp_extract_all(content, '{POM}', 2)), lambda z: z[1] || ':' || z[2]), regexp_extract_all(content, '{POM}', 3) from manifests where path = 'pom.xml')),
gradle as (select repo, path, i, string_split(x, ':') as p from (select repo, path, unnest(regexp_extract_all(content, '{GRADLE}', 1)) as x, unnest(range(0, len(regexp_extract_all(content, '{GRADLE}', 1)))) as i from manifests where path = 'build.gradle')),
deps as (
select repo, path, manager, place, seq, regexp_extract(line, '{REQUIREMENT}', 1) as name, case when regexp_extract(line, '{REQUIREMENT}', 2) = '' then '*' else trim(regexp_extract(line, '{REQUIREMENT}', 2)) end as version from pip where regexp_matches(line, '{REQUIREMENT}') and not regexp_matches(line, '^(#|-|$)')
union all select repo, path, manager, place, case when s in ('dependencies', 'require') then 0 else 100 end + i, k, regexp_replace(json_extract_string(j, '$."' || k || '"'), '^[\\^~>=<!]+', '') from (select repo, path, s, j, manager, place, unnest(json_keys(j)) as k, unnest(range(0, len(json_keys(j)))) as i from npm where j is not null) where not (manager = 'composer' and starts_with(k, 'php'))
union all select repo, path, manager, place, i, name, coalesce(nullif(version, ''), '*') from pairs
union all select repo, path, 'gradle', 6, i, p[1] || ':' || p[2], coalesce(p[3], '*') from gradle where len(p) >= 2
union all select repo, path, 'pipenv', 2, i, regexp_extract(line, '{PIPENV}', 1), regexp_replace(regexp_extract(line, '{PIPENV}', 2), '^[\\^~>=<!]+', '') from ml where path = 'Pipfile' and regexp_matches(line, '{PIPENV}') and regexp_extract(line, '{PIPENV}', 1) not in ('name', 'requires', 'packages')
union all select repo, path, 'pyproject', 3, i, regexp_extract(bare, '^"([a-zA-Z0-9_.-]+)', 1), case when regexp_extract(bare, '([><=!~]+\\s*[\\d.*]+)', 1) = '' then '*' else regexp_extract(bare, '([><=!~]+\\s*[\\d.*]+)', 1) end from ml where path = 'pyproject.toml' and i > list_position(l, 'dependencies = [') and i < list_position(l, ']')
union all select repo, path, 'cargo', 4, i, regexp_extract(bare, '^([\\w-]+)', 1), regexp_extract(bare, '"(.+)"', 1) from (select *, max(case when starts_with(line, '[') then i end) over (partition by repo, path order by i) as head from ml where path = 'Cargo.toml') where l[head] = '[dependencies]' and contains(bare, '=')
union all select repo, path, 'go', 7, i, regexp_extract(bare, '^(?:require\\s+)?(\\S+)', 1), regexp_extract(bare, '(\\S+)$', 1) from ml where path = 'go.mod' and not starts_with(bare, '//') and (i > list_position(l, 'require (') and i < list_position(l, ')') or regexp_matches(bare, '^require\\s+[^\\s(]'))
union all select repo, path, 'pub', 10, i, regexp_extract(bare, '^(\\w+):', 1), ltrim(regexp_extract(bare, ':\\s*(.+)$', 1), '^') from ml where path = 'pubspec.yaml' and i > list_position(l, 'dependencies:') and i < list_position(l, 'dev_dependencies:'))"""
UNIQUE = DEPENDENCIES + ", firsts as (select *, row_number() over (partition by repo, lower(name) order by place, path, seq) as nth from deps), uniq as (select repo, name, version, manager, version in ('*', 'latest', 'HEAD') as outdated from firsts where nth = 1)"
LARGE = "coalesce(files_changed, 0) > 30 or coalesce(insertions, 0) + coalesce(deletions, 0) > 1000"
