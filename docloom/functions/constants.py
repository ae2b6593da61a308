"""Names, patterns and lists that documents and rule profiles share."""

# Style of each role.
ROLE_STYLES = {
    "body": "Normal", "body_text": "Normal", "title": "Title", "subtitle": "Subtitle",
    "chapter_title": "Heading 1", "level_2_section": "Heading 2", "level_3_section": "Heading 3", "level_4_section": "Heading 4",
    "heading_1": "Heading 1", "heading_2": "Heading 2", "heading_3": "Heading 3", "heading_4": "Heading 4",
    "caption": "Caption", "figure_caption": "Caption", "table_caption": "Caption", "equation_caption": "Caption",
    "bibliography": "Bibliography", "reference_entry": "Bibliography", "long_quote": "Quote", "answer": "Normal", "teaching_callout": "Normal",
}
ROLE_STYLES |= {f"heading{level}": f"Heading {level}" for level in range(1, 10)}

# Other names of roles.
ROLE_ALIASES = {
    "body_text": "body", "chapter_title": "heading_1", "level_2_section": "heading_2", "level_3_section": "heading_3", "level_4_section": "heading_4",
    "heading1": "heading_1", "heading2": "heading_2", "heading3": "heading_3", "heading4": "heading_4", "caption": "all_captions", "all": "all_captions",
}

# Properties that a rule of each kind may set.
ALLOWED_PROPERTIES = {
    "style": [
        "font_name", "font_name_ascii", "font_name_east_asia", "font_name_complex_script", "font_size_pt", "bold", "italic", "color_hex", "alignment",
        "space_before_pt", "space_after_pt", "line_spacing", "line_spacing_rule", "line_spacing_pt", "first_line_indent_pt", "first_line_indent_chars",
        "left_indent_pt", "right_indent_pt", "keep_with_next", "keep_together", "page_break_before", "widow_control",
    ],
    "caption": ["numbering_mode", "preserve_identifier", "domain_context", "allow_automatic_renumbering", "preserve_table_cell_caption_position"],
    "section": [
        "page_width_mm", "page_height_mm", "orientation", "margin_top_mm", "margin_bottom_mm", "margin_left_mm", "margin_right_mm", "gutter_mm",
        "different_first_page_header_footer", "odd_and_even_pages_header_footer", "page_size_policy", "mirror_margins", "margin_inner_ratio",
        "margin_outer_ratio", "margin_top_ratio", "margin_bottom_ratio", "header_distance_ratio", "footer_distance_ratio",
    ],
    "table": ["table_style", "alignment", "repeat_header_row", "prevent_row_split"],
    "field": ["update_on_open", "mark_fields_dirty", "convert_explicit_markers", "rebuild_heading_numbering", "heading_levels", "strip_manual_heading_prefixes", "chapter_start"],
    "equation": ["require_editable_equations", "preserve_editable_objects", "block_formula_images"],
}

# Names of one font.
FONT_ALIASES = {
    "songti": ["宋体", "simsun", "nsimsun", "新宋体"],
    "heiti": ["黑体", "simhei"],
    "kaiti": ["楷体", "kaiti", "simkai", "楷体_gb2312"],
    "fangsong": ["仿宋", "fangsong", "simfang", "仿宋_gb2312"],
}

# Words that tell the domain of a caption.
ARCHITECTURE_TERMS = ["建筑", "平面图", "立面图", "剖面图", "详图", "大样"]
CIVIL_ENGINEERING_TERMS = ["土木", "结构", "钢结构", "混凝土", "梁", "柱", "桁架", "基础", "节点", "截面", "断面"]

# Patterns. White space and digits are Unicode's, and only a newline ends a line.
FLAGS = "(?dU)"
HEADING_LEVELS = {4: r"^\s*\d+\.\d+\.\d+\.\d+\.?\s*\S", 3: r"^\s*\d+\.\d+\.\d+\.?\s*\S", 2: r"^\s*\d+\.\d+\.?\s*\S", 1: r"^\s*第\s*[0-9一二三四五六七八九十百]+\s*章\s*\S"}
CHAPTER = r"^\s*第\s*([0-9一二三四五六七八九十百]+)\s*章"
CAPTION = r"^\s*(图|表)\s*(\d+(?:\.\d+){1,3})\s*[-－—–]\s*(\d+)\s*(\S.*)$"
LOOSE_CAPTION = r"^\s*(图|表)\s*(\S.*)?$"
IDENTIFIED_CAPTION = r"^(\s*(?:图|表)\s*)([0-9]+(?:[.．-][0-9]+)*)((?:\s+|\s*[-－—–]\s*(?=\D)))(\S.*)$"
DRAWING_MARK = r"(?:^|\s)\d+(?:-\d+)+\s*(?:剖面|断面|截面|节点|详图|大样|立面|平面)"
FIELD_MARKER = r"\[\[(?:TOC|PAGE|(?:REF|PAGEREF|SEQ):[A-Za-z0-9_.-]+)\]\]"
FIELD = r"^\s*([A-Za-z]+)(?:\s+([^\\\s]+))?"
CONTENT_PART = r"^word/(?:document|header\d+|footer\d+|footnotes|endnotes)\.xml$"
NUMERALS = {"一": 1, "二": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
CAPTION_ACTIONS = ["preserve", "style_only", "replace_identifier", "convert_to_seq", "move_caption"]
MAP_VERSIONS, SEMANTIC_MAP_VERSIONS = ["1.0", "1.1", "1.2"], ["1.1", "1.2"]
ROW_END, CELL_END = "␞", "␟"
TOLERANCE = 0.05
