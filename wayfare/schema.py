"""Schemas of the engine's rows, as DDL."""

FRONTMATTER = "array<struct<key:string,value:string>>"
SECTIONS = "array<struct<heading:string,level:int,first:int,last:int>>"
LINKS = "array<struct<target:string,anchor:string,sentence:string,heading:string,line:int,in_root:boolean,kind:string>>"
PAGES = "path string, text string"
PARSED = f"path string, title string, frontmatter {FRONTMATTER}, sections {SECTIONS}, links {LINKS}"
PREVIEW = f"path string, title string, frontmatter {FRONTMATTER}, first_paragraph string, headings array<string>, leads array<string>"
SECTION_SCORES = "array<struct<heading:string,first:int,last:int,score:double>>"
LINK_SCORES = "array<struct<target:string,scent:double,keep:boolean>>"
JUDGMENT = f"query_id string, path string, relevance double, sections {SECTION_SCORES}, links {LINK_SCORES}"
DETAIL = "struct<model:string,questions:int,requests:int,relevance_level:double,relevance_confidence:double,choice_confidence:array<double>,input_tokens:long,output_tokens:long,latency:struct<secs:long,nanos:long>>"
STORED = f"key string, format int, judgment struct<relevance:double,sections:array<struct<heading:string,lines:array<int>,score:double>>,links:{LINK_SCORES}>, detail {DETAIL}"
VISITED_LINKS = "array<struct<target:string,scent:double,keep:boolean,in_root:boolean,followed:boolean,reason:string>>"
VISITED = (
    "query_id string, path string, relevance double, scent double, path_score double, depth int, via array<string>, "
    f"sections {SECTION_SCORES}, links {VISITED_LINKS}"
)
TRACE = (
    "event string, t_ms long, query string, mode string, threshold double, path string, path_score double, depth int, via array<string>, "
    f"post_index int, latency_ms long, relevance double, cached boolean, sections {SECTION_SCORES}, links {LINK_SCORES}, "
    "source string, target string, scent double, reason string, earned_a_place boolean"
)
RUN_ROW = (
    "query_id string, category string, condition string, repeat int, wiki string, ok boolean, metrics map<string,double>, "
    "model_asked_for string, models array<string>, detail string"
)
LEDGER = "wiki string, query string, condition string, repeat int, model string, out string, ok boolean, cost_usd double"
GOLD_EVAL = "struct<queries:array<struct<id:string,query:string,mode:string,entry:string,expected:array<string>,note:string>>>"
GOLD_HARNESS = "struct<queries:array<struct<id:string,category:string,query:string,entry:string,mode:string,wanted:array<string>,expected:array<string>>>>"
