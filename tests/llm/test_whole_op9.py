"""Only what browsers do not show is left out of a page's text."""

import pytest

from titrelake.llm import html

CASES = {
    '<p>One <svg class="icon"/> two</p><p>three</p>': ["One two", "three"],
    "<p>One</p><object data=x><p>two</p><p>three</p>": ["One", "two", "three"],
    "<p>One</p><select><option>two</option><p>three</p>": ["One", "two", "three"],
    "<p>One <math><mi>x</mi><mo>=</mo><mn>2</mn></math> two</p><p>three</p>": ["One x=2 two", "three"],
    "<p>One <object data=x>two</object></p><p>three</p>": ["One two", "three"],
    "<p>One</p><xmp>two <b> &amp;</xmp><p>three</p>": ["One", "two <b> &amp;", "three"],
    "<p>One <math> two</p><p>three</p>": ["One two", "three"],
    "<svg><p>One</p><svg><title>no</title></svg><p>two</p><noscript>x": ["One", "two", "x"],
    "<p>One<svg a='>'><svg><title>no</title></svg> no</svg></p><select><option>no</select><noscript>no</noscript><template>no</template>": ["One"],
    "<p>One</p><noscript><img alt=\"it's></noscript><p>two \"three\"</p>": ["One", 'two "three"'],
    "<p>One</p><script>no <svg> <p>no": ["One"],
    "<p>One</p><textarea>no</textarea><iframe>no</iframe><style>no</style><script>'</svg>'</script><p>two</p>": ["One", "two"],
}


@pytest.mark.parametrize("page", CASES)
def test_blocks_drop_nothing_else(page):
    assert [b.text for b in html.blocks(page)] == CASES[page]
