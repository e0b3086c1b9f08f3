"""Predicates on on-screen text by the role of the element that shows it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loam.functions.text import SPACE, clusters, col, trimmed

# Interface strings and roles that carry no content.
UI_STRINGS = (
    "Cancel", "Apply", "Reset", "Save", "Delete", "Copy", "Paste",
    "Cut", "Undo", "Redo", "Select All", "Print", "Share", "Export", "Import",
    "キャンセル", "適用", "リセット", "保存", "削除", "コピー", "貼り付け",
    "切り取り", "元に戻す", "やり直し", "すべて選択", "印刷", "共有", "書き出し", "読み込み",
    "Loading...", "読み込み中...", "Please wait...", "お待ちください...",
    "Error", "エラー", "Warning", "警告", "Info", "情報",
    "Navigation", "ナビゲーション", "Menu", "メニュー", "Toolbar", "ツールバー",
    "Header", "ヘッダー", "Footer", "フッター", "Sidebar", "サイドバー",
)
PLACEHOLDERS = ("Search...", "検索...", "Enter text...", "テキストを入力...", "Type here...", "ここに入力...")
SKIPPED_ROLES = ("AXToolbar", "AXMenuBar", "AXScrollBar")
SKIPPED_SUBROLES = ("AXToolbarButton", "AXNavigationBar", "AXSecureTextField")
SKIPPED_TITLES = (
    "Close", "閉じる", "Minimize", "最小化", "Zoom", "拡大/縮小", "Back", "戻る", "Forward", "進む",
    "Reload", "再読み込み", "Bookmarks", "ブックマーク", "History", "履歴", "Downloads", "ダウンロード", "Preferences", "環境設定",
)
CJK = "[぀-ゟ゠-ヿ一-龯가-힯]"
NUMBERS_AND_SYMBOLS = r"""\A[\p{Nd}!@#$%^&*()_+\-=\[\]{}|;':",./<>?]*\z"""


def quality_content(text: Column | str, role: Column | str) -> Column:
    """Whether a text is content, given its role; null roles take the general rules."""
    t, r = trimmed(text), F.coalesce(col(role), F.lit(""))
    letters = clusters(t)
    repeated = (letters > 2) & t.rlike(r"^(\X)\1+$")
    ui = ~r.isin("AXMessage", "AXText", "AXGroup") & t.isin(*UI_STRINGS)
    url = (r != "AXLink") & (t.startswith("http") | t.startswith("www.") | t.contains("://"))
    path = t.startswith("/") | t.contains("\\") | t.endswith(".app") | t.endswith(".exe")
    too_long = F.exists(F.split(t, SPACE), lambda w: (clusters(w) > 50) & ~w.rlike(CJK))
    placeholder = r.isin("AXTextField", "AXTextArea") & t.isin(*PLACEHOLDERS)
    short_button = (r == "AXButton") & (letters < 2)
    return F.coalesce((t != "") & ~repeated & ~ui & ~url & ~path & ~t.rlike(NUMBERS_AND_SYMBOLS) & ~too_long & ~placeholder & ~short_button, F.lit(False))


def skipped(role: Column | str, subrole: Column | str, title: Column | str) -> Column:
    """Whether an element and all below it are left out."""
    role, subrole, title = col(role), F.coalesce(col(subrole), F.lit("")), F.coalesce(col(title), F.lit(""))
    return role.isNull() | F.coalesce(role.isin(*SKIPPED_ROLES), F.lit(False)) | subrole.isin(*SKIPPED_SUBROLES) | title.isin(*SKIPPED_TITLES)
