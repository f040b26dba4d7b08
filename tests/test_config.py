from corpusloom.config import Settings, default_repo_key, slug


def test_slug():
    assert slug("Qwen/Qwen3-Embedding-0.6B") == "qwen3_embedding_0_6b"
    assert slug("///") == "model"
    assert slug("  A b--C ") == "a_b_c"


def test_table_name_and_key(tmp_path):
    s = Settings(repo_key="My Repo", profile_name="cpu_e5", embedding_model="x/Small-64", index_schema_version=3)
    assert s.table_name("code") == "corpusloom_my_repo_cpu_e5_small_64_code_v3"
    key = default_repo_key(tmp_path)
    assert key.startswith(slug(tmp_path.name) + "_") and len(key.rsplit("_", 1)[1]) == 8
    assert Settings(repo_root=str(tmp_path)).key == key


def test_load_from_environment():
    env = {"CORPUSLOOM_INCLUDE_GLOBS": "a/**, b/** ,", "CORPUSLOOM_DOCUMENT_PREFIX": "x\\ny", "CORPUSLOOM_MAX_CHUNK_CHARS": "500", "CORPUSLOOM_SAFE_EXCLUDES": "0"}
    s = Settings.load(env, repo_key="k")
    assert s.include_globs == ["a/**", "b/**"] and s.document_prefix == "x\ny" and s.max_chunk_chars == 500 and not s.safe_excludes and s.key == "k"


def test_index_profile():
    assert Settings(profile_name="p").index_profile() == "p"
    bare = {"profile_name": " ", "query_template": "{query}", "document_prefix": ""}
    assert Settings(**bare).index_profile() == "default"
    assert Settings(**bare | {"document_prefix": "d: "}).index_profile() == "formatted"
    assert Settings(**bare, query_prompt_name="q").index_profile() == "default"
    assert Settings(**bare, query_prompt_name="q", embedding_backend="http").index_profile() == "formatted"
