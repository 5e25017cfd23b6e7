"""Hand-written pages."""

CATALOGUE = """<div class="mw-parser-output">
 <h3>Consumables[edit]</h3><div>Clarity (50)<br>Blink Dagger (2250 )<br>no price</div>
 <h2>Active Artifacts[edit]</h2><h3>Tier 1</h3><div>Alpha<br>Beta</div><h2>Other</h2><h3>Tier 1</h3><div>skip</div>
 <h2>Combat</h2><table><tbody><tr><td><b>old</b></td></tr></tbody></table>
 <table><tbody><tr><td><b>Aa/Bb</b><ul><li>sub</li></ul></td></tr><tr><td>no bold: skipped</td></tr>
  <tr><td><b>Head-up display (HUD)</b></td></tr></tbody></table>
</div>"""

INFOBOX = """<table class="fo-nttax-infobox-wrapper fo-nttax-infobox"><tr><th><div><div style="text-align:center">Sword</div></div></th></tr>
<tr><td style="font-style: italic">Sharp.</td></tr><tr><td><table style="text-align:left">
<tr><th colspan="2">Costs</th></tr><tr><th>Stock</th><td>60</td></tr>
<tr><th>Bonus</th><td>+5</td></tr><tr><td>+7</td></tr>
<tr><th colspan="2">Recipe</th></tr><tr><td><a title="Great Sword (900)">g</a></td></tr>
<tr><td><a title="Sword">s</a></td></tr><tr><td><a title="Hilt">h</a><a title="Recipe (650)">r</a></td></tr>
</table></td></tr></table>"""

CARD = """<div class="spellcard-wrapper" id="Id"><div class="spellcard"><div style="border-bottom:1px"><span style="font-weight:bold">Blink</span><img alt="Melee"><img alt="Melee"><div title="Default Hotkey"><span>Q</span></div></div>
<div><div class="spelltad">Ability</div><div class="spelltad_value">Point Target</div><div class="spelltad">Affects</div><div class="spelltad_value"><abbr title="Enemies">En</abbr></div></div>
<div style="display:flex;font-size:12px"><div class="target_x"><img alt=""></div><div>Teleports far</div></div>
<div class="spelltrait_value"><b>Radius:</b> 300</div><div class="spelltrait_value">radius : 400</div><div class="spelltrait_value">Radius: 500</div>
<div class="spellcost_icon"><a title="Cooldown Time">c</a></div><div class="spellcost_value">15</div><div class="spellcost_icon"><a title="Mana">m</a></div><div class="spellcost_value">60</div><div class="spellcost_icon"><a title="x">m</a></div>
<div class="spelldesc"><div>one</div><div>two <img alt="pic"></div></div><div class="spelllore">Old lore</div></div>"""

TABS = """<div class="tabs-dynamic navigation-not-searchable"><ul class="nav nav-tabs"><li data-count="1">Details</li><li data-count="2">Show All</li><li data-count="3">Misc</li></ul><div class="tabs-content"><div class="content1"><ul><li>a<ul><li>b</li></ul>tail</li></ul></div><div class="content2"><div>box <tt>mod_x</tt><div>effect</div></div></div></div></div>"""

GRID = """<table class="mw-datatable"><thead><tr><th><a title="Hero Name">Hero</a></th><th>Val</th><th>W</th></tr></thead><tbody>
<tr><td><a title="Axe">x</a><a title="Axe">y</a></td><td><abbr title="Twelve">12</abbr></td><td>a1 foo</td></tr>
<tr><td><img alt="Pic"></td><td></td><td rowspan="2">tall<span class="sortkey">zz</span></td></tr>
<tr><td><a href="/x">Link</a></td><td>q  r</td></tr>
<tr><td>plain</td><td colspan="2">wide</td></tr></tbody></table>"""

SKILLS = """<div class="skilllist"><div class="skilllist-title">Skills</div><ul><li class="skilllist-lite"><a href="#"><img></a><a>Axe</a> x <a>Call</a></li><li class="skilllist-lite">Lina – Fire</li>
<li class="skilllist-rich"><div class="skilllist-rich-head"><a>Tiny</a><a>Toss</a></div><div class="skilllist-rich-desc">Throws <b>far</b></div></li></ul></div>
<div class="skilllist"><ul><li class="skilllist-lite"><a>A</a><a>B</a></li></ul></div>"""


def content(*parts: str) -> str:
    return '<div class="mw-parser-output">' + "".join(parts) + "</div>"
